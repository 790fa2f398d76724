import datetime as dt
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates, text as T, vectors
from tidemark.operators.evaluation import exact_p, t_point
from tidemark.operators.packing import LIMIT, TARGET, pack


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("  Ab\t C ", "ab c"), ("x Y", "x y"), ("", "")])
def test_normal_form(spark, text, want):
    assert one(spark, T.normal_form("t"), t=text) == want


@pytest.mark.parametrize("text, n, want", [("abcd", 3, ["abc", "bcd"]), ("ab", 3, ["ab"]), ("", 3, []), ("aaaa", 2, ["aa"]), ("a😀bc", 3, ["a😀b", "😀bc"])])
def test_char_grams(spark, text, n, want):
    assert one(spark, T.char_grams("t", n), t=text) == want


def test_query_tokens(spark):
    assert one(spark, T.query_tokens("t"), t="东京 Trip 42") == ["东京 trip 42", "东", "京", "trip", "42"]


def test_answers(spark):
    assert one(spark, T.json_object("t"), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, T.json_object("t"), t="none") is None
    assert one(spark, T.final_answer("t"), t="<think>a</think> Answer: b") == "b"
    assert one(spark, T.verdict("t"), t='{"correct": true, "x": false}') is True
    assert one(spark, T.verdict("t"), t='{"correct": false}') is False
    assert one(spark, T.slug("t"), t="-- Hello, World! 东京 --") == "hello-world-东京"
    assert one(spark, T.unknown_answer("t"), t="I Don't know it") is True
    assert one(spark, T.base_name("t"), t="a#alias") == "a"
    assert one(spark, T.sentences("t"), t="One. Two!\n\nThree") == ["One.", "Two!", "Three"]


def test_overlapping_occurrences(spark):
    from tidemark.operators.retrieval import occurrences

    assert one(spark, occurrences(F.col("t"), F.col("p")), t="ellelle", p="elle") == 2
    assert one(spark, occurrences(F.col("t"), F.col("p")), t="aaaa", p="aa") == 3


def test_dates(spark):
    assert one(spark, dates.add_months_overflow(F.to_date("t"), 1), t="2023-01-31") == dt.date(2023, 3, 3)
    assert one(spark, dates.event_date(F.col("t")), t="2023-05") == dt.date(2023, 5, 1)
    assert one(spark, dates.event_date(F.col("t")), t="May") is None
    none, low = F.lit(None).cast("timestamp"), F.lit("2024-01-10").cast("timestamp")
    assert one(spark, dates.intersects(none, none, low, low)) is True
    assert one(spark, dates.strictly_intersects(none, none, low, low)) is False
    early = F.lit("2023-12-11").cast("timestamp")
    assert one(spark, dates.decay(early, early, low, low)) == pytest.approx(math.exp(-1))


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(a(1.0, 0.0), a(1.0, 1.0))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(a(0.0, 0.0), a(1.0, 1.0))) == 0
    assert one(spark, vectors.cosine(a(1.0), a(1.0, 1.0))) == 0


def test_statistics(spark):
    from fractions import Fraction
    from math import comb

    pairs = [(0, 0), (5, 5), (0, 5), (7, 2), (40, 61), (1000, 900), (3, 4000), (250_000, 251_000)]
    got = {(r["b"], r["c"]): r["p"] for r in spark.createDataFrame(pairs, "b long, c long").select("b", "c", exact_p("b", "c").alias("p")).collect()}
    for b, c in pairs[:-1]:
        want = Fraction(2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)) if b != c else 1
        assert got[b, c] == pytest.approx(float(min(1, want)), rel=1e-9)
    assert got[250_000, 251_000] == pytest.approx(0.158, abs=0.001)
    assert one(spark, t_point(F.lit(1))) == 12.706 and one(spark, t_point(F.lit(35))) == 2.021
    assert one(spark, t_point(F.lit(120))) == 1.98 and one(spark, t_point(F.lit(121))) == 1.962


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=1300), max_size=8))
def test_pack(texts):
    rows = pack(list(enumerate(texts)))
    assert all(len(t) <= LIMIT for t, _ in rows)
    kept = [t for t in texts if t.strip()]
    assert sorted({p for _, places in rows for p in places}) == [i for i, t in enumerate(texts) if t.strip()]
    assert sum(len(t) for t, _ in rows) == sum(map(len, kept)) + sum(len(p) - 1 for _, p in rows)
    assert TARGET < LIMIT


def test_judge_decisions(spark):
    from tidemark.operators.writes import judge_decisions

    said = 'Here: ```json {"evict": ["a", "b"], "merge": [{"names": ["c", "d"], "into": {"name": "c", "content": "both"}}, {"names": ["e"], "into": {"name": "x", "content": "y"}}], "conflicts": [{"loser": "f", "winner": "g"}]} ``` done'
    rows = [("n", said), ("o", "nothing to do"), ("p", "{broken: ["), ("q", "{not json}"), ("r", "{}"), ("s", None)]
    merges, conflicts, evictions, problems = judge_decisions(spark.createDataFrame(rows, "ns string, answer string"))
    assert [(r["ns"], r["nth"], r["into"], r["names"], r["content"]) for r in merges.orderBy("nth").collect()] == [("n", 0, "c", ["c", "d"], "both"), ("n", 1, "x", ["e"], "y")]
    assert [tuple(r) for r in conflicts.collect()] == [("n", "f", "g")] and {tuple(r) for r in evictions.collect()} == {("n", "a"), ("n", "b")}
    assert {tuple(r) for r in problems.collect()} == {("o", "no object"), ("p", "no object"), ("q", "malformed"), ("s", "no object")}
