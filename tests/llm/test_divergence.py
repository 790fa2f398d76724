"""Source divergence against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, rank int"


def plain(rows, least=10, top=10):
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = TERM.findall((text or "").translate(LOW))
        df[lang or ""].update(set(w))
        counts[lang or "", source or ""].update(w)
    out = []
    for lang, source in counts:
        kept = [t for t, n in df[lang].items() if n >= least]
        sums = Counter()
        for (a, _), c in counts.items():
            if a == lang:
                sums.update({t: c[t] for t in kept})

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, q = p(counts[lang, source]), p(sums)
        pairs = []
        for a, other in counts:
            if a == lang and other != source:
                theirs = p(counts[a, other])
                pairs.append((other, sum(f(own[t], theirs[t]) for t in kept)))
        terms = [(t, f(own[t], q[t])) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, of, most in (("pair", pairs, None), ("term", terms, top)):
            of = sorted(of, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(of)]
    return sorted(out)


def corpus(kind):
    rng = random.Random(6)
    if kind == "empty":
        return []
    if kind == "bare":
        return [(None, None, None), ("", "x", None), ("1 2 3", None, "s"), ("rare words", "x", "t")]
    words = [rng.choice(["a", "É", "é", "z", "日本", "\U0001f600", "q", "B"]) + rng.choice("abcdeXYZ") for _ in range(60)]
    rows = [(rng.choice(["-", " ", "5", "_"]).join(rng.choices(words, k=rng.randrange(40))), rng.choice(["de", "de", "de", None, "", "fr"]), rng.choice(["one", "two", "tHree", "ü", None])) for _ in range(400)]
    return rows + [rows[0]] * 50 + [(" ".join(rng.choices(words, k=5000)), "fr", "long"), ("x" * 9000, "fr", "long"), (None, "de", "silent")] + [("Long" * 50, "only", "s")] * 10


SMALL = [D.Bounds(700, 20, 5, 40, 8, 4), D.Bounds(3000, 3000, 7, 1 << 20, 1 << 20, 30)]


@pytest.mark.parametrize("kind, bounds", [("empty", D.Bounds()), ("bare", D.Bounds()), ("corpus", D.Bounds()), ("corpus", SMALL[0]), ("corpus", SMALL[1])])
def test_divergence(spark, kind, bounds):
    rows = corpus(kind)
    got = D.divergence(spark.createDataFrame([(i, *r, 1, "x", 2) for i, r in enumerate(rows)], SCHEMA), bounds=bounds).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_smoothed_is_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(1, 2**53)
        c = [rng.randrange(total + 1) for _ in range(5)] + [0, total]
        assert D.smoothed(np.array(c), total).tolist() == [1 + 10**9 * x // total for x in c]
