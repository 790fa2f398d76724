import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, lineage, neardup, packing, retrieval
from tidemark.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(None, 3), (5, 4), (4, 5)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(3)
        edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute(edges)


def test_lifecycle(spark):
    log = [(1, 1, "append"), (1, 2, "tombstone"), (1, 3, "restore"), (2, 1, "tombstone"), (2, 2, "append"), (3, 1, "append"), (3, 2, "purge"), (3, 3, "restore")]
    got = {r["item"]: r["state"] for r in lineage.heads(spark.createDataFrame(log, "item long, seq long, action string")).collect()}
    assert got == {1: "active", 2: "active", 3: "purged"}


def test_admission_skips_and_prefix_stops(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 3)], "g string, pos int, size long")
    items = F.sort_array(F.collect_list(F.struct("pos", "size")))
    assert [x["pos"] for x in rows.groupBy("g").agg(packing.admit(items, 10).alias("k")).first()["k"]] == [1, 3]
    assert [r["pos"] for r in packing.prefix_within(rows, ["g"], ["pos"], F.col("size"), 10).collect()] == [1]


def test_near_duplicates(spark):
    rng = random.Random(1)
    sets = [(i, [f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 14))]) for i in range(60)]
    got = {(r["a"], r["b"]) for r in neardup.gram_pairs(spark.createDataFrame(sets, "id long, g array<string>"), "id", "g", 0.7).collect()}
    s = {i: set(g) for i, g in sets}
    assert got == {(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b])}


def test_vector_pairs_of_all_blocks(spark):
    from tidemark.plans.catalogue import QUERIES

    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, 2.0])]
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = sorted((i, j) for i, x in rows[:60] for j, y in rows[:60] if i < j and cos(x, y) > 0.4)
    got = neardup.vector_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.4, block=9).collect()
    assert sorted((r["a"], r["b"]) for r in got) == want
    # pairs across labels, which vec_pairs_gt leaves out
    sf = "/root/testdata/sf0.01"
    assert QUERIES["vec_pairs_gt"](spark, sf).count() == 5 and QUERIES["vec_pairs_all"](spark, sf).count() == 59


def test_overlay_of_many_centres(spark, tmp_path):
    from tidemark.plans.catalogue import QUERIES

    n = 300
    rows = [(i, [1.0 if k == i % n else 0.0 for k in range(n)], i % n) for i in range(2 * n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["cluster_overlay"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["centre"]) for r in got) == [(i, i % n) for i in range(2 * n)]


def test_fusion_and_quota(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, name string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "chunk-z", 2)], "query_id int, name string, rank int")
    fused = {r["name"]: r["score"] for r in retrieval.fuse({"a": a, "b": b}, ["a", "b"]).collect()}
    assert fused == {"x": 1 / 61, "y": 1 / 62 + 1 / 61, "chunk-z": 1 / 62}
    hits = retrieval.with_quota(retrieval.fuse({"a": a, "b": b}, ["a", "b"]), 2, 1, F.col("name").startswith("chunk-"))
    assert [r["name"] for r in hits.orderBy("rank").collect()] == ["y", "chunk-z"]


def test_walk_excludes_seeds_and_earlier_steps(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 3.0)], "entity_a string, entity_b string, weight double")
    df = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1)], "entity string, df long")
    got = {r["entity"]: r["score"] for r in graph.walk(spark.createDataFrame([("a",)], "entity string"), edges, df).collect()}
    assert got == {"b": 1.0, "c": 0.5, "d": 1.5}


def test_edges_accumulate(spark):
    rows = [(" A", "b", "co", 0.0, 1), ("b", "a", "co", 2.0, 2), ("a", "b", "syn", 0.4, 1), ("b", "a", "syn", 0.9, 2), ("a", "A", "co", 1.0, 1), ("a", "c", "odd", 1.0, 1)]
    got = {(r["a"], r["b"], r["kind"]): r["weight"] for r in graph.accumulate(spark.createDataFrame(rows, "a string, b string, kind string, weight double, ts int")).collect()}
    assert got == {("a", "b", "co"): 3.0, ("a", "b", "syn"): 0.9}


def test_greedy_cover(spark):
    rows = spark.createDataFrame([("g", 1, 1, ["a"]), ("g", 2, 2, ["a", "b"]), ("g", 3, 3, ["c"])], "g string, position int, id int, items array<string>")
    assert [r["id"] for r in packing.cover(rows, "g").orderBy("pick").collect()] == [2, 3]


@pytest.mark.parametrize("side", [None, "side"])
@pytest.mark.parametrize("spread", [60, 4000])
def test_gram_pairs(spark, monkeypatch, side, spread):
    from tidemark.operators import neardup as N

    monkeypatch.setattr(N, "ROWS", 37)
    rng = random.Random(3)
    rows = []
    for i in range(260):
        base = rng.sample(range(spread), rng.randrange(1, 50)) if i % 3 == 0 or not rows else [x if rng.random() < 0.9 else rng.randrange(spread) for x in rows[-1][1]]
        rows.append((i, base, "ab"[rng.randrange(2)]))
    # one gram in every set, and one set of it alone
    rows = [(i, g + [10**9], s) for i, g, s in rows] + [(900, [10**9], "a"), (901, [10**9], "b"), (902, [], "a"), (903, None, "b")]
    want = {(a, b): len(set(g) & set(h)) / len(set(g) | set(h)) for a, g, s in rows if g for b, h, u in rows if h and a < b and (side is None or s != u)}
    got = N.gram_pairs(spark.createDataFrame(rows, "id long, grams array<long>, side string"), "id", "grams", 0.6, side=side).collect()
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items() if v >= 0.6} and len(got) > 20


def test_cover_against_plain_greedy(spark):
    rng = random.Random(7)
    rows = [(g, k, 100 * g + k, rng.sample(range(40), rng.randrange(0, 9))) for g in range(3) for k in range(30)]
    want = set()
    for g in range(3):
        left, covered = {(k, i): set(x) for h, k, i, x in rows if h == g}, set()
        for pick in range(1, 13):
            gain, _, key = max((len(x - covered), -k, (k, i)) for (k, i), x in left.items())
            if not gain:
                break
            covered |= left.pop(key)
            want.add((g, pick, key[1], gain))
    got = packing.cover(spark.createDataFrame(rows, "g int, position int, id int, items array<int>"), "g").collect()
    assert {tuple(r) for r in got} == want and len(want) > 15
    assert packing.cover(spark.createDataFrame([], "g int, position int, id int, items array<int>"), "g").count() == 0


def test_contained(spark):
    from tidemark.operators import containment as C

    rng = random.Random(8)
    rows = [(g, k, rng.sample(range(30), rng.randrange(0, 8)) + ([99] if k % 2 else [])) for g in range(4) for k in range(40)]
    words = lambda x: [f"w{i}" for i in x]
    parts = spark.createDataFrame([(g, k, words(x)) for g, k, x in rows], "group int, part int, words array<string>")
    for least in (0.3, 0.6, 1.0):
        want = {(g, k, j): len(set(x) & set(y)) / len(x) for g, k, x in rows if x for h, j, y in rows if g == h and len(set(x) & set(y)) / len(x) >= least}
        got = C.contained(parts, parts.withColumnRenamed("part", "whole"), least).collect()
        assert {(r["group"], r["part"], r["whole"]): r["share"] for r in got} == want and len(want) > 100
    texts = spark.createDataFrame([(1, "The cat, and THE dog-7 Ünd"), (2, None), (3, "of the")], "k int, t string")
    assert {r["k"]: set(r["w"]) for r in texts.select("k", C.content_words(F.col("t")).alias("w")).collect()} == {1: {"cat", "dog", "7", "ünd"}, 2: set(), 3: set()}
