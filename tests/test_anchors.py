"""Names are found in texts without comparing each name with each text."""

from pyspark.sql import functions as F

from tidemark.operators import search as S


def test_named_in_equals_contains(spark):
    long = "a name of rather more than thirty-two characters"
    said = ["the quick brown fox", f"said {long}, twice", f"said {long[:40]} and no more", "日本語のテキスト 🙂", "a", "", None, "aaaa"]
    names = ["quick", "a", " ", long, "本語の", "🙂", "aa", "zebra", "the quick brown fox"]
    texts = spark.createDataFrame([(f"e{i}", s) for i, s in enumerate(said)], "name string, said string")
    asked = spark.createDataFrame([(n,) for n in names], "entity string")
    got = sorted((r["name"], r["entity"]) for r in S.named_in(texts, asked).collect())
    assert got == sorted((f"e{i}", n) for i, s in enumerate(said) if s is not None for n in names if n in s)


def test_anchors_have_no_nested_loop(spark):
    n = F.col("id").cast("int")
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))")
    entries = spark.range(50).select(F.format_string("e%02d", "id").alias("name"), F.lit(None).cast("string").alias("trigger"), F.concat(F.lit("met Alice in "), n % 3).alias("content"), day.alias("updated_at"), day.alias("event_start"), F.lit(None).cast("timestamp").alias("event_end"))
    asked = spark.createDataFrame([(1, ("before", None, "alice")), (2, ("after", None, "in 1")), (3, ("after", None, "bob"))], "query_id long, w struct<intent:string,at:date,entity:string>")
    out = S.anchors({"entries": entries}, asked)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()  # before, each name read all texts
    assert sorted((r["query_id"], str(r["at"])) for r in out.collect()) == [(1, "2024-02-19 00:00:00"), (2, "2024-02-19 00:00:00")]
