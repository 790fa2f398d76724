import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import intent, needs, timeline

D = dt.date
NOW = D(2024, 6, 15)
#: question: (first, last, intent, state, entity, at, fuzzy)
CASES = {
    "What happened in May 2023?": (D(2023, 5, 1), D(2023, 5, 31), "range", "historical", None, None, False),
    "what happened on 2024-03-05?": (D(2024, 3, 5), D(2024, 3, 5), "range", "historical", None, None, False),
    "plans between 3 May 2024 and August 2024": (D(2024, 5, 3), D(2024, 8, 31), "range", "current", None, None, False),
    "What happened last month?": (D(2024, 5, 1), D(2024, 5, 31), "relative", "historical", None, None, False),
    "What has happened recently?": (D(2024, 5, 16), NOW, "relative", "current", None, None, False),
    "去年发生了什么？": (D(2023, 1, 1), D(2023, 12, 31), "relative", "historical", None, None, False),
    "上周的旅行是什么？": (D(2024, 6, 3), D(2024, 6, 9), "relative", "historical", None, None, False),
    "yesterday": (D(2024, 6, 14), D(2024, 6, 14), "relative", "historical", None, None, False),
    "what is planned today": (NOW, NOW, "relative", "current", None, None, False),
    "What happened before the conference on 2023-05-07?": (None, D(2023, 5, 6), "before", "historical", "conference", D(2023, 5, 7), False),
    "What happened after Alice's birthday on 7 May 2023?": (D(2023, 5, 8), None, "after", "historical", "alice's birthday", D(2023, 5, 7), False),
    "May 1, 2023 after the pottery class": (D(2023, 5, 2), None, "after", "historical", "", D(2023, 5, 1), False),
    "2023年5月7日之前发生了什么？": (None, D(2023, 5, 6), "before", "historical", "", D(2023, 5, 7), False),
    "2023年5月7日以前发生了什么？": (None, D(2023, 5, 6), "before", "historical", "", D(2023, 5, 7), False),
    "2023年发生了什么？": (D(2023, 1, 1), D(2023, 12, 31), "range", "historical", None, None, False),
    "What is Alice's current job?": (None, None, "current", "current", None, None, False),
    "What was Alice's job?": (None, None, "historical", "historical", None, None, False),
    "What was Alice's job in 2023?": (D(2023, 1, 1), D(2023, 12, 31), "range", "historical", None, None, False),
    "What happened between 2022 and 2023?": (D(2022, 1, 1), D(2023, 12, 31), "range", "historical", None, None, False),
    "What happened after May 2023 and before July 2023?": (D(2023, 5, 1), D(2023, 7, 31), "range", "historical", None, None, False),
    "events before 2023": (None, D(2022, 12, 31), "before", "historical", "", D(2023, 1, 1), False),
    "他以前住在哪里": (None, None, "historical", "historical", None, None, False),
    "陶艺课之前发生了什么？": (None, None, "before", "historical", "陶艺课", None, False),
    "What did Melanie do before the pottery class?": (None, None, "before", "historical", "pottery class", None, False),
    "what happened on 31 February 2023 then": (D(2023, 2, 1), D(2023, 2, 28), "range", "historical", None, None, False),
    "who came last week, before": (D(2024, 6, 3), D(2024, 6, 9), "relative", "historical", None, None, False),
    "What is Alice's favorite color?": None, "reach 2048 in the game": None, "the model supports 2023 tokens": None, "photos of the cabin 2023 renovation": None, "did Alice run the Berlin 2023 marathon": None, "": None,
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_windows(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(CASES)], "i int, q string")
    got = {r["i"]: r["w"] for r in df.select("i", intent.temporal_window(F.col("q"), F.lit(NOW)).alias("w")).collect()}
    for i, (q, want) in enumerate(CASES.items()):
        assert (None if got[i] is None else tuple(got[i])) == want, q


def test_window_without_anchor(spark):
    w, today = one(spark, intent.temporal_window(F.lit("yesterday"), F.lit(None).cast("date")), F.current_date())
    assert w["fuzzy"] and w["last"] == today - dt.timedelta(1)


@pytest.mark.parametrize("text, want", [("in 2023 or so", "window"), ("has it changed", "evolution"), ("what was it", "evolution"), ("the latest one", "current"), ("in 20234", "degraded"), ("a colour", "degraded")])
def test_resolution_mode(spark, text, want):
    assert one(spark, intent.resolution_mode(F.lit(text)))[0] == want


@pytest.mark.parametrize("text, want", [("How many trips?", True), ("list all the books", True), ("which of the two is more costly", True), ("哪些书", True), ("多少钱", False), ("when did it happen", False)])
def test_enumeration(spark, text, want):
    assert one(spark, intent.enumerates(F.lit(text)))[0] is want


@pytest.mark.parametrize("text, want", [("list 3 things", 3), ("which 4 cities", 4), ("列出三个城市", 3), ("最近10次", 10), ("list 0 or 5 facts", 5), ("who?", None)])
def test_cardinality(spark, text, want):
    assert one(spark, needs.cardinality(F.lit(text)))[0] == want


def test_need(spark):
    n = one(spark, needs.need(F.lit("What did Alice and 张伟 buy before 2024-05-06? Show the latest list of 2 items.")))[0]
    assert (n["entities"], n["times"], n["count"], n["state"]) == (["Alice", "张伟"], ["2024-05-06", "before"], 2, "latest")
    assert n["operands"] == ["show the latest list of 2 items", "what did alice and 张伟 buy before 2024-05-06"]
    assert one(spark, needs.operands(F.lit("Compare tea and then  coffee")))[0] == ["coffee", "compare tea"]
    assert one(spark, needs.operands(F.lit("red vs. blue vs green")))[0] == ["blue vs green", "red"]


def test_merged_need(spark):
    n = lambda e, c, s: F.struct(F.array(*map(F.lit, e)).alias("entities"), F.array().cast("array<string>").alias("times"), F.array().cast("array<string>").alias("operands"), F.lit(c).cast("int").alias("count"), F.lit(s).alias("state"))
    base = n(["A"], None, "latest")
    assert one(spark, needs.merged_need(base, n(["B", "A"], None, "latest|change")))[0][0] == ["A", "B"]
    for proposal in (n(["B"], None, "latest"), n(["A"], 2, "latest"), n(["A"], None, "change")):
        assert one(spark, needs.merged_need(base, proposal))[0] is None


@pytest.mark.parametrize("text, want", [
    ("1:56 pm on 8 May, 2023", dt.datetime(2023, 5, 8)), ("8 Sep, 2023", dt.datetime(2023, 9, 8)), ("May 8, 2023", dt.datetime(2023, 5, 8)), ("2023-05-08 10:11", dt.datetime(2023, 5, 8, 10, 11)), ("2023-05-08T10:11:12Z", dt.datetime(2023, 5, 8, 10, 11, 12)),
    ("2023-05-08", dt.datetime(2023, 5, 8)), ("8/5/2023", None), ("31 February, 2023", None), ("", None),
])
def test_dataset_dates(spark, text, want):
    assert one(spark, timeline.dataset_date(F.lit(text)))[0] == want


@pytest.mark.parametrize("text, at, unit", [
    ("moved next month", D(2023, 3, 3), "month"), ("two weeks ago", D(2023, 1, 17), "day"), ("3 days later", D(2023, 2, 3), "day"), ("last year", D(2022, 1, 31), "year"), ("YESTERDAY", D(2023, 1, 30), "day"), ("0 days ago", None, None),
    ("yesterday and tomorrow", None, None), ("someday", None, None),
])
def test_relative_dates(spark, text, at, unit):
    r = one(spark, timeline.relative_date(F.lit(text), F.lit(D(2023, 1, 31))))[0]
    assert r is None if at is None else (r["at"], r["unit"]) == (at, unit)


def test_span_texts(spark):
    s = lambda n, u: one(spark, timeline.span_text(F.lit(n), F.lit(u)))[0]
    assert [s(1, "day"), s(-45, "day"), s(45, "month"), s(800, "year")] == ["1 day", "45 days", "about 1 month", "about 2 years"]
    assert one(spark, timeline.category_name(F.lit(9)), timeline.category_name(F.lit(99)))[:] == ("temporal-reasoning", "category-99")
