"""Benchmark decontamination against a plain search, and the audit queries against their SQL."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination as D
from tidemark.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def plain(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (at := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[at]
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(kind):
    rng = random.Random(9)
    word = lambda: rng.choice(["A", "b", "Ö", "ö", "日本語", "x9", "İs", "ß"]) + str(rng.randrange(3))
    say = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(n))
    docs = [(rng.randrange(60), say(rng.randrange(60))) for _ in range(80)] + [(None, None), (None, None), (5, ""), (5, " .;"), (None, "b0 b1 b2")]
    items = [(k, say(rng.randrange(25))) for k in range(30)] + [(3, say(12)), (None, say(11)), (None, say(30)), (70, None), (71, "?!"), (72, "b0")]
    long = say(3000)
    docs += [(100, long), (100, long), (101, say(15) + " " + items[0][1]), (102, f"start {items[-5][1]} end"), (103, "z " * 40)]
    items += [(80, " ".join(long.split()[500:540])), (81, "z " * 14), (82, "Q " * 10), (83, "b1 b2"), (84, "z z z")]
    if kind == "long items":
        items = [(i, t) for i, t in items if len(words(t)) >= 10]
    return {"no docs": [], "nothing": []}.get(kind, docs), {"no items": [], "nothing": []}.get(kind, items)


@pytest.mark.parametrize("kind", ["all", "long items", "no docs", "no items", "nothing"])
@pytest.mark.parametrize("broadcast", [D.BROADCAST, 0])
def test_decontaminate(spark, kind, broadcast):
    docs, items = tables(kind)
    a = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, window string, n_words int")
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, key int")
    got = D.decontaminate(a, b, broadcast=broadcast).collect()
    assert sorted((str(r["doc_id"]), *list(r)[1:]) for r in got) == plain(docs, items)


def test_prefix_is_the_rarest_shingle(spark, tmp_path):
    docs = spark.createDataFrame([("a b c " * 50 + "c d e f",), ("b c d",), ("b c d",)], "text string").select(D.words("text").alias("words"))
    windows = spark.createDataFrame([(1, "a b c a b c d e".split()), (2, "q a b c".split()), (3, ["c", "d"])], "wid long, window array<string>")
    prefix, widths = D.rarest(D.Work(spark, "rarest"), docs, windows, 3, 1 << 20)
    rows = {r["wid"]: r for r in prefix.collect()}
    assert widths == [2, 3] and set(rows) == {1, 3} and rows[1]["place"] == 5


@pytest.mark.parametrize("name", ["op11_centroids", "op12_divergence", "op13_decontamination"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    both = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert both[0].equals(both[1])
