"""Entities of orders are dealt by entry to as many tasks as they need; their edges come of one pass."""

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans import model
from tidemark.plans.registry import Tables


def test_tasks_grow_with_the_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(model, "LINES", 100, raising=False)
    t = Tables(spark, sf_dir)
    rows = t.entities.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(rows) > 40 and max(r["n"] for r in rows) < 250  # 4 tasks of some 1,500 before


def test_edges_count_entries_once(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "b"), (2, "a"), (3, "a"), (3, None), (None, "a"), (None, "b")]
    got = {(r["entity_a"], r["entity_b"]): r["weight"] for r in G.co_edges(spark.createDataFrame(rows, "entry long, entity string")).collect()}
    assert got == {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0}
