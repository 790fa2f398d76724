"""Links of texts, counted in blocks of bits, against the sets themselves; what is sent is the texts, once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neardup as N, text_links as T
from tidemark.operators.components import connected_components


def _texts(draw):
    words = ["".join(draw.choice("abcdefgéß東 ") for _ in range(draw.randint(2, 9))) for _ in range(60)]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(3, 80))) for _ in range(25)]
    out = []
    for _ in range(260):
        own = list(draw.choice(base))
        for _ in range(draw.randint(0, len(own) // 6)):
            own[draw.randrange(len(own))] = draw.choice("abcxyz")
        out.append("".join(own[: draw.randint(len(own) // 2, len(own))]))
    return [*out, None, "", "abc", "😀 abcdef".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.mark.parametrize("side", [None, "side"])
def test_links_equal_sets(spark, monkeypatch, side):
    texts = _texts(random.Random(5))
    monkeypatch.setattr(T, "ROWS", 7)
    rows = spark.createDataFrame([(i, t, "ab"[i % 3 == 0]) for i, t in enumerate(texts)], "id long, text string, side string")
    links = T.text_links(rows, "id", "text", 6, 0.5, side=side).cache()
    sets = [set(N.grams_of(t, 6, "none").tolist()) for t in texts]
    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and c / (len(sets[i]) + len(sets[j]) - c) >= 0.5 and not (side and (i % 3 == 0) == (j % 3 == 0)):
                pairs.append((j, i))
    want = {}
    for x in sum(pairs, ()):
        want[x] = want.get(x, 0) + 1
    assert len(pairs) > 50 and {r["a"]: r["n"] for r in links.groupBy("a").agg(F.sum("links").alias("n")).collect()} == want
    of_pairs = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert sorted(connected_components(links, "a", "b").collect()) == sorted(of_pairs.collect())


def test_bits_bound_what_sets_share():
    draw = np.random.default_rng(3)
    for _ in range(200):
        n, m = draw.integers(1, 400, 2)
        x, y = (np.unique(draw.integers(0, 500, k)) for k in (n, m))
        o, p = T.octave_of(len(x)), T.octave_of(len(y))
        (a, c), (b, d) = (T.folded(*(v[None] for v in T.slots_of(s, k)), k - min(o, p)) for s, k in ((x, o), (y, p)))
        rest = min(len(x) - T._bits(a) - T._bits(c), len(y) - T._bits(b) - T._bits(d))[0]
        assert len(np.intersect1d(x, y)) <= T._bits(a & b)[0] + T._bits(c & d)[0] + rest
        assert len(np.intersect1d(x, y)) <= T._bits(a & b)[0] + min(len(x) - T._bits(a), len(y) - T._bits(b))[0]


def test_split_leakage_sends_texts_once(spark, sf_dir):
    from tidemark.plans.catalogue import QUERIES

    stages = lambda: {x.stageId(): x.shuffleWriteBytes() for x in (s.apply(i) for s in [spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(s.size()))}
    before = stages()
    QUERIES["split_leakage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    sent = sum(n for k, n in stages().items() if k not in before)
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert sent < 1.5 * size  # before, grams of 8 bytes in each cell of two blocks
