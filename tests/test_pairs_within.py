"""Vector pairs within a label are compared in blocks."""

import random

from tidemark.operators import neardup


def test_vector_pairs_within_labels(spark):
    draw = random.Random(7)
    rows = [(i, "abc"[i % 3] if i % 10 else None, [draw.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = sorted((i, j) for i, l, x in rows for j, m, y in rows if i < j and l is not None and l == m and cos(x, y) > 0.4)
    got = neardup.vector_pairs(spark.createDataFrame(rows, "id long, label string, v array<double>"), "id", "v", 0.4, block=9, within="label").collect()
    assert sorted((r["a"], r["b"]) for r in got) == want


def test_query_has_no_row_for_each_pair_of_a_label(spark, sf_dir):
    from tidemark.plans.catalogue import QUERIES

    plan = QUERIES["vec_pairs_gt"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "vec_id" in plan  # before, a join by label made all pairs as rows
