"""N-gram Jaccard join and fingerprints against plain versions."""

import collections
import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest

from tidemark.llm import fingerprints as P, ngram_jaccard as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(rows):
    flat = [(i, s) for i, group in sets_of(rows).items() for s in group]
    parent = {i: i for i, _ in flat}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(flat):
        for b, t in flat[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), find(i)) for i, s in flat)


def family(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "a b c d", "a b c d e", "A b c d  e", "z " * 30, "z " * 31]
    for n, size, edits in ((30, 60, 2), (40, 120, 4), (10, 8, 1), (25, 300, 12)):
        texts += family(rng, [word() for _ in range(size)], n, edits)
    for n in (5, 10, 15, 20):
        texts += [" ".join([*passage, *[f"u{rng.randrange(10**6)}" for _ in range(n)]]) for _ in range(8)]
    texts += ["same copy of a text in many rows " * 3] * 20 + ["q" * 70_000, " ".join(word() for _ in range(9000))]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("case", ["corpus", "empty", "repeated ids"])
def test_jaccard(spark, case):
    rows = {"corpus": corpus(), "empty": [], "repeated ids": [(1, "a b c d e f"), (1, "k l m n o p"), (2, "a b c d e f"), (3, "k l m n o p"), (4, "k l m n o p q r")]}[case]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert got == components(rows)


def test_rows_without_id(spark):
    got = J.jaccard_components(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == {(None, None): 1, (4, 2): 1, (2, 2): 1}


def test_prefixes_meet():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(2, 60)
        same = rng.randrange(1, n + 1)
        a = set(range(same)) | {100 + i for i in range(n - same)}
        b = set(range(same)) | {200 + i for i in range(rng.randrange(0, n))}
        if 5 * len(a & b) < 4 * len(a | b) or a == b:
            continue
        order = {x: rng.random() for x in a | b}
        large, small = sorted((a, b), key=len, reverse=True)
        for s in (1, 2):
            p, q = J.prefixes(len(large))[0] + s - 1, J.prefixes(len(small))[1] + s - 1
            assert len(set(sorted(large, key=order.get)[:p]) & set(sorted(small, key=order.get)[:q])) >= s


def test_overlap_bound():
    rng = np.random.default_rng(1)
    for n in (1, 7, 40, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64)]))
        assert J.overlap_bound(J.histogram(a), J.histogram(b)) >= len(np.intersect1d(a, b))


def test_boundary_follows_cost():
    sizes = {n: 10 for n in range(2, 200)}
    assert J.choose_boundary(sizes, 0.0) <= J.choose_boundary(sizes, 5.0) <= J.choose_boundary(sizes, 50.0)


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip()


@pytest.mark.parametrize("rows_in_bucket", [512, 3])
def test_fingerprints(spark, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(P, "ROWS", rows_in_bucket)
    rng = random.Random(8)
    rows = [(rng.randrange(-50, 10**9), t) for t in ["é A", "é a", "", None, "Hello\tworld", " hello world ", "ﬁ n", "FI N", "ß", "SS", "Straße", "STRASSE", "ΣΑΣ", "σασ", "ς", "İ", "ǅ", "\u00a0a\u2003b ", "x" * 50_000, *[" ".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(60)]]]
    assert len({i for i, _ in rows}) == len(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in P.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[canon(t)].append(i)
    prints = collections.defaultdict(set)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"], r["group_id"]) == (float(canon(edited) == canon(t)), float(canon(after) == canon(t)), min(groups[canon(t)]))
        prints[canon(t)].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert P.fingerprints(spark.createDataFrame([], schema)).count() == 0
    lone = P.fingerprints(spark.createDataFrame([(3, "abc")], schema)).first()
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()
    assert P.fingerprints(spark.createDataFrame([(3, "a"), (3, "a"), (None, "b"), (3, "c")], schema)).count() == 4


def test_clashing_fingerprints_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "digest", lambda canon: F.lit("00"))
    rows = {r["doc_id"]: (r["near_edited"], r["near_next"], r["group_id"]) for r in P.fingerprints(spark.createDataFrame([(1, "abc"), (2, "ABC"), (3, "b")], "doc_id long, text string")).collect()}
    assert rows == {1: (0.0, 0.0, 1), 2: (0.0, 1.0, 1), 3: (1.0, 0.0, 3)}
    got = {r["doc_id"]: r["group_id"] for r in P.exact_groups(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b ")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}
