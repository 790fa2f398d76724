"""Quality: all labelled rows train the strengths and the threshold."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.sampling import fold


def test_threshold_is_of_all_labelled_rows(spark):
    rng = np.random.default_rng(4)
    kinds = [list("abcdefgh"), list("abcd.,;!#%")]
    word = lambda bad: "".join(rng.choice(kinds[bad], rng.integers(2, 9)))
    # of two overlapping kinds, more rows of each label than the 3,000 that were drawn before
    rows = [(i, " ".join(word(rng.random() < 0.3 + 0.4 * (i % 2)) for _ in range(12)), int(i % 2 == 0)) for i in range(11_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    scored = quality.quality(df.select("doc_id", "text"), df.select("doc_id", F.col("label").alias("quality")))
    trained = scored.where(fold("doc_id", 4) != 2).join(df.select("doc_id", "label"), "doc_id").select("predicted", "label").toPandas()
    assert len(trained) > 8000 and trained["predicted"].sum() == trained["label"].sum()
    assert (trained["predicted"] == trained["label"]).mean() > 0.8


def test_each_row_is_in_a_pair():
    x = np.random.default_rng(1).normal(size=(23, quality.FEATURES))
    for good in (3, 11, 20):
        y = (np.arange(23) < good).astype(int)
        d = quality.differences(x, y, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
        z = quality.expand(x)
        met = {(i, j) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0) if (np.abs(d - (z[i] - z[j])).sum(1) < 1e-9).any()}
        assert {i for i, _ in met} | {j for _, j in met} == set(range(23))


def test_groups_hold_both_labels():
    assert quality.group_count({(5, 0): 1, (9, 1): 1, (4000, 1): 7}) in (1, 2, 4, 8)
    counts = {(p, label): 100 for p in range(quality.GROUPS) for label in (0, 1)}
    assert quality.group_count(counts) == quality.GROUPS
    assert quality.group_count({**counts, (17, 1): 0}) == quality.GROUPS // 2


def test_value_at_a_rank(spark):
    values = [0.5] * 300 + [1e-300, -4.0, 7.25, 7.25, 1e9] + np.random.default_rng(2).normal(size=500).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    for k in (0, 1, 250, 400, len(values) - 1):
        assert quality.at_rank(df, k) == sorted(values)[k]
