"""Areas and percentiles that no task computes alone, against plain ones."""

import random

from tidemark.operators import diagnostics as D, evaluation as E


def test_auc_over_ranges(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 900):
        points = sorted((rng.randrange(300) / 300, rng.random()) for _ in range(n))
        want = min(1.0, max(0.0, sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))))
        got = E.auc(spark.createDataFrame(points, "false_rate double, recall double")).first()["auc"]
        assert abs(got - want) < 1e-9


def test_percentiles_by_counts(spark):
    rng = random.Random(4)
    for n in (0, 1, 7, 400):
        rows = [(True, 1, 1, rng.random() < 0.8, False, 1, 1, rng.choice([None, *range(1, 40)])) for _ in range(n)] + [(False, 0, 0, False, False, 0, 0, 3)]
        ranks = sorted(r[7] for r in rows if r[3] and r[7] is not None)
        at = lambda p: ranks[max(1, min(len(ranks), int(len(ranks) * p + 0.5))) - 1] if ranks else 0
        schema = "parsed boolean, gold_facts int, dated_facts int, resolved boolean, buried boolean, buried_facts int, lifted_facts int, rank_pool int"
        s = D.temporal_summary(spark.createDataFrame(rows, schema)).first()
        assert (s["p50"], s["p90"]) == (at(0.5), at(0.9))
