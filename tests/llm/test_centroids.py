"""Centroid clustering against plain integer k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def plain(rows, k=16, size=64, rounds=3):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**50 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    raw = {id(q): v for (_, q), v in zip(kept, [v for _, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)])}
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", raw[id(r[1])]))
    cents = [q for _, q in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    where = lambda q: min(range(len(cents)), key=lambda j: (dist(q, cents[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(where(q), []).append(q)
        for j, g in groups.items():
            cents[j] = [sum(c) // len(g) for c in zip(*g)]
    out = [(i, where(q), q) for i, q in kept]
    out = [(i, j, dist(q, cents[j])) for i, j, q in out]
    per = {j: sum(d for _, b, d in out if b == j) for j in range(len(cents))}
    total = sum(per.values())
    return sorted((str(i), j, d, per[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in out)


def table(kind):
    rng = random.Random(3)
    draw = lambda scale: [rng.gauss(0, scale) for _ in range(64)]
    if kind == "empty":
        return []
    if kind == "few":
        return [(i, draw(0.2)) for i in range(5)]
    if kind == "odd rows":
        bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63]
        return [(i, v) for i, v in enumerate(bad)] + [(100 + i % 30, draw(0.2)) for i in range(80)] + [(None, draw(0.2)) for _ in range(9)] + [(7, [0.0] * 64)] * 40
    if kind == "ties":
        return [(i, [float(rng.randrange(2))] + [0.0] * 63) for i in range(300)]
    if kind == "larger":
        return [(i, [*([3e6] if i % 3 else [0.3]), *draw(0.2)[1:]]) for i in range(120)]
    return [(i, draw(0.2) if i % 3 else draw(2.0**20)) for i in range(120)]


@pytest.mark.parametrize("kind", ["empty", "few", "odd rows", "ties", "large", "larger"])
def test_cluster(spark, kind):
    rows = table(kind)
    got = C.cluster(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == plain(rows)


def test_intervals_hold():
    rng = np.random.default_rng(4)
    for scale in (3, 300, 1 << 20, 1 << 26):
        x, c = rng.integers(-scale, scale, (500, 64)), rng.integers(-scale, scale, (16, 64))
        c[5], c[9] = c[3], c[3] + (np.arange(64) == 7)  # ties and near ties
        x[:50] = c[3] + rng.integers(-1, 2, (50, 64))
        at, doubt = C.nearest(x, c)
        exact = ((x[:, None, :].astype(object) - c[None]) ** 2).sum(2)
        assert at.tolist() == [min(range(16), key=lambda j: (r[j], j)) for r in exact.tolist()]
        assert 0 < doubt < len(x)


def test_distances_beyond_64_bits_are_an_error(spark):
    rows = [(i, [(-1.0) ** i * 1e9] * 64, 1, "x") for i in range(40)]
    with pytest.raises(Exception, match="exceeds 64 bits"):
        C.cluster(spark.createDataFrame(rows, SCHEMA), k=1).collect()


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = C.cluster(df).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])
