"""Links of similar sets, counted in blocks, against their pairs."""

import random

import pytest

from tidemark.operators import neardup as N
from tidemark.operators.components import connected_components


@pytest.mark.parametrize("side", [None, "side"])
def test_links_equal_pairs(spark, monkeypatch, side):
    monkeypatch.setattr(N, "ROWS", 37)
    draw = random.Random(11)
    base = [draw.sample(range(400), 30) for _ in range(12)]
    sets = [sorted(set(draw.choice(base)[: draw.randint(20, 30)]) | set(draw.sample(range(400), draw.randint(0, 6)))) for _ in range(240)]
    rows = spark.createDataFrame([(i, g, "ab"[i % 2]) for i, g in enumerate(sets)] + [(999, [], "a")], "id long, grams array<long>, side string").cache()
    pairs = N.gram_pairs(rows, "id", "grams", 0.6, side=side).collect()
    links = N.gram_links(rows, "id", "grams", 0.6, side=side)
    want = {}
    for r in pairs:
        for x in (r["a"], r["b"]):
            want[x] = want.get(x, 0) + 1
    assert want and {r["a"]: r["n"] for r in links.groupBy("a").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()} == want
    of_pairs = connected_components(spark.createDataFrame([(r["a"], r["b"]) for r in pairs], "a long, b long"), "a", "b")
    assert sorted(connected_components(links, "a", "b").collect()) == sorted(of_pairs.collect())


def test_copies_make_no_pairs(spark):
    rows = spark.range(500).selectExpr("id", "array(1L, 2L, 3L) AS grams")
    assert N.gram_links(rows, "id", "grams", 0.7).count() == 500  # of 124,750 pairs


@pytest.mark.parametrize("name, columns", [("neardup_pairs", ["doc_id", "component", "links"]), ("split_leakage", ["doc_id", "split", "component", "links"])])
def test_queries_have_a_row_for_each_document(spark, sf_dir, name, columns):
    from tidemark.plans.catalogue import QUERIES

    out = QUERIES[name](spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 50 <> 0" if name == "neardup_pairs" else "true").count()
    assert out.columns == columns and out.count() == ids  # before, a row for each pair
