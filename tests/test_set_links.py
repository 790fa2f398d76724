"""Links of sets in blocks that are files: bounds leave no link out, kinds change nothing, each set is sent once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neardup as N, set_links as S


def _blocks(sets, often):
    at = [np.isin(often, s) for s in sets]
    rest = [np.setdiff1d(s, often) for s in sets]
    bits = np.packbits(np.stack([np.pad(a, (0, N.FREQUENT - len(a))) for a in at]), axis=1)
    whole = np.unpackbits(bits, axis=1)
    return {"n": np.array([len(s) for s in sets]), "bits": bits, "turned": np.packbits(whole.T, axis=1), "ones": whole.sum(0), "at": np.cumsum([0, *map(len, rest)]), "rest": np.concatenate([np.empty(0, np.int64), *rest])}


@pytest.mark.parametrize("pair", [1, 1 << 20])
def test_cell_hits_equal_all_pairs(monkeypatch, pair):
    monkeypatch.setattr(S, "PAIR", pair)
    monkeypatch.setattr(S, "LEVELS", (8, 32, 1 << 30))
    draw = np.random.default_rng(7)
    often, base = np.arange(300), [draw.choice(400, 90, replace=False) for _ in range(6)]
    sets = [np.unique(np.append(draw.choice(base[draw.integers(6)], draw.integers(60, 91), replace=False), draw.choice(400, draw.integers(0, 25)))) for _ in range(300)]
    x, y = _blocks(sets[:140], often), _blocks(sets[140:], often)
    got = {(int(i), int(j)) for _, a, b in S._cell_hits(x, y, 0.6, False) for i, j in zip(a, b)}
    same = {(int(i), int(j)) for _, a, b in S._cell_hits(x, x, 0.6, True) for i, j in zip(a, b)}
    near = lambda s, t: (c := len(np.intersect1d(s, t))) / (len(s) + len(t) - c) >= 0.6
    assert got == {(i, j) for i, s in enumerate(sets[:140]) for j, t in enumerate(sets[140:]) if near(s, t)} and got
    assert same == {(i, j) for i, s in enumerate(sets[:140]) for j, t in enumerate(sets[:140]) if i < j and near(s, t)}


def test_kinds_change_no_links(spark):
    draw = random.Random(2)
    rows = spark.createDataFrame([(i, np.packbits(np.array([draw.random() < (0.9 if k % 2 == i % 2 else 0.1) for k in range(64)])).tobytes()) for i in range(80)], "id long, bits binary")
    mean, centre = S._centres(rows, 2)
    of = rows.mapInArrow(lambda it: S._kinds(it, mean, centre), "id long, bits binary, kind int").groupBy("kind").agg(F.collect_set(F.col("id") % 2).alias("p"), F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in of) == [40, 40] and all(len(r["p"]) == 1 for r in of)


def test_each_set_is_sent_once(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 16)
    draw = random.Random(4)
    rows = spark.createDataFrame([(i, draw.sample(range(80), 50)) for i in range(640)], "id long, grams array<long>")
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in (s.apply(i) for s in [spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(s.size()))}
    before = stages()
    N.gram_links(rows, "id", "grams", 0.7)
    assert sum(n for k, n in stages().items() if k not in before) < 640 * 8  # before, each set in the 40 cells of its block
