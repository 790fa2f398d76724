"""How a keyword query is read: runs of scripts, phrases of all-or-nothing matches, and the fall-back to fragments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points that count as CJK, and the characters of ASCII words.
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{F900}-\x{FAFF}\x{2E80}-\x{2EFF}"
    r"\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{FF65}-\x{FF9F}"
)
WORD = r"A-Za-z0-9_'\-"
LEAST = 3  # characters of a phrase that the index can find


def runs(text: Column) -> Column:
    """The runs of ASCII word characters and of CJK characters of a query, in order."""
    return F.regexp_extract_all(text, F.lit(rf"[{WORD}]+|[{CJK}]+"), F.lit(0))


def _cjk(run: Column) -> Column:
    return run.rlike(rf"^[{CJK}]")


def mode(text: Column) -> Column:
    """How a query is answered: none where it has no run or one that the index refuses, like with a CJK run that is too short, else match.

    One short CJK run makes the whole query a search for fragments. An ASCII run with - or ' is no legal phrase: the
    keyword signal of such a query is empty, and does not fall back.
    """
    r = runs(text)
    short = F.exists(r, lambda x: _cjk(x) & (F.length(x) < LEAST))
    illegal = F.exists(r, lambda x: ~_cjk(x) & x.rlike(r"[-']"))
    return F.when(F.size(r) == 0, "none").when(short, "like").when(illegal, "none").otherwise("match")


def phrases(text: Column) -> Column:
    """The distinct phrases that a match must hold all of: ASCII runs in lower case, and all trigrams of CJK runs."""
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substr(x, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(runs(text), lambda x: F.when(_cjk(x), grams(x)).otherwise(F.array(F.lower(x))))))


def tokens(text: Column) -> Column:
    """The runs of a text, in lower case, in which alone a phrase can occur."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9_]+|[{CJK}]+"), F.lit(0))


def sampled_trigrams(text: Column, most: int = 12) -> Column:
    """Every k-th trigram of a text, at most that many, from all of it; none below three characters."""
    n = F.length(text) - 2
    step = F.when(n > most, F.ceil(n / most)).otherwise(1).cast("int")
    picked = F.transform(F.sequence(F.lit(1), n, step), lambda i: F.substr(text, i, F.lit(3)))
    return F.when(n >= 1, F.array_distinct(picked)).otherwise(F.array().cast("array<string>"))
