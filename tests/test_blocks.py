"""Blocks of vectors: what cells pass on, and what they say of odd vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine
from tidemark.operators import retrieval as R
from tidemark.plans import diagnostic_queries as Q
from tidemark.plans.registry import Tables


def _vectors(spark, n=500, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, 5))
    v[100:400] = v[100]  # copies
    return spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "name long, v array<double>"), v


@pytest.mark.parametrize("dot", [False, True])
def test_best_by_blocks(spark, dot):
    left, v = _vectors(spark)
    v = v if dot else v / np.linalg.norm(v, axis=1, keepdims=True)
    right = left.where("name % 100 = 0").withColumnRenamed("name", "query_id")
    found = R.blocks_cosine(left, right, 20, rows=70, dot=dot, by_name=True)
    per_cell = found.groupBy("query_id").count().toPandas()["count"]
    assert per_cell.max() <= 9 * 80  # blocks pass on their best; of copies no more than the first of each value
    got = {}
    for r in R.top(found, ["query_id"], [F.desc(F.round("cos", 9)), "name"], 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["name"])
    for q in range(0, 500, 100):
        assert got[q] == sorted(range(500), key=lambda i: (-round(float(v[i] @ v[q]), 9), i))[:20]


def test_diagnostics_pass_on_the_best_only(spark, sf_dir, monkeypatch):
    limits, blocks = [], R.blocks_cosine
    monkeypatch.setattr(R, "blocks_cosine", lambda left, right, limit, **k: limits.append(limit) or blocks(left, right, limit, **k))
    for by in ("cos", "dot"):
        Q._results(Tables(spark, sf_dir), by)
    assert limits == [301, 301]  # before: None, a row for each pair of vector and query


def test_shares_of_odd_vectors(spark):
    nan = float("nan")
    odd = [(1, [1.0, 0.0]), (2, [0.5, -2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 0.0]), (8, []), (9, [-1.0, 0.0])]
    left = spark.createDataFrame(odd, "name long, v array<double>")
    right = left.where("name IN (1, 2, 6, 9)").select(F.col("name").alias("query_id"), "v")
    share = F.least(F.greatest((cosine(F.col("v"), F.col("q")) + 1) / 2, F.lit(0.0)), F.lit(1.0))
    pairs = left.crossJoin(right.withColumnRenamed("v", "q")).select("query_id", share.alias("s"))
    want = {r["query_id"]: (r["m"], r["x"]) for r in pairs.groupBy("query_id").agg(F.avg("s").alias("m"), F.max("s").alias("x")).collect()}
    for rows in (2, 4096):
        got = {r["query_id"]: (r["mean"], r["most"]) for r in R.cosine_shares(left, right, rows).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert R.cosine_shares(left.limit(0), right).count() == R.cosine_shares(left, right.limit(0)).count() == 0


def test_matrix_of_sliced_columns():
    rows, got = R.matrix(pa.chunked_array([pa.array([[9.0, 9.0], None, [1.0, 2.0], [1.0], [3.0, None]]).slice(1), pa.array([[5.0, 6.0]])]), 2)
    assert rows.tolist() == [1, 4] and got.tolist() == [[1.0, 2.0], [5.0, 6.0]]
