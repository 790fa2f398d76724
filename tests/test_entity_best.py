"""The best entries by shared entities are found without a row for each query and entry that share one."""

import random

from pyspark.sql import functions as F

from tidemark.operators import retrieval as R


def test_entity_best_equals_all_counts(spark):
    draw = random.Random(3)
    rows = [(e, f"t{int(draw.expovariate(0.3))}") for e in range(200) for _ in range(draw.randint(1, 7))]
    entities = spark.createDataFrame(rows + rows[:50], "entry long, entity string")
    tokens = entities.where("entry % 5 = 0").select(F.col("entry").alias("query_id"), F.col("entity").alias("token"))
    want = R.top(R.entity_counts(tokens, entities), ["query_id"], [F.desc("matched"), "entry"], 10).select("query_id", "entry", "matched", "rank")
    got = R.entity_best(tokens, entities, 10).select("query_id", "entry", "matched", "rank")
    assert sorted(got.collect()) == sorted(want.collect())


def test_frequent_entity_meets_its_first_entries(spark):
    entities = spark.range(3000).select(F.col("id").alias("entry"), F.lit("common").alias("entity"))
    tokens = spark.range(100).select(F.col("id").alias("query_id"), F.lit("common").alias("token"))
    out = R.entity_best(tokens, entities, 10)
    assert [r["entry"] for r in out.where("query_id = 7").orderBy("rank").collect()] == list(range(10))
    out.write.format("noop").mode("overwrite").save()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    newest = max((stages.apply(i) for i in range(stages.size())), key=lambda x: x.stageId())
    assert newest.shuffleReadRecords() <= 100 * 10 + 100  # of 300,000 pairs


def test_entity_best_of_later_entries(spark):
    """Pairs and larger sets that only later entries hold, beside pairs that the first ones fill."""
    draw = random.Random(8)
    rows = [(e, f"t{draw.randrange(6)}") for e in range(900) for _ in range(draw.randint(1, 9))] + [(e, f"u{draw.randrange(40)}") for e in range(300, 900) for _ in range(5)]
    entities = spark.createDataFrame(rows, "entry long, entity string")
    tokens = entities.where("entry % 30 = 0").select(F.col("entry").alias("query_id"), F.col("entity").alias("token"))
    want = R.top(R.entity_counts(tokens, entities), ["query_id"], [F.desc("matched"), "entry"], 10).select("query_id", "entry", "matched", "rank")
    assert sorted(R.entity_best(tokens, entities, 10).select("query_id", "entry", "matched", "rank").collect()) == sorted(want.collect())
    text = lambda rows, c: rows.withColumn(c, F.format_string("%05d", c))  # noqa: E731  entries of another kind
    got = R.entity_best(tokens, text(entities, "entry"), 10).select("query_id", F.col("entry").cast("long").alias("entry"), "matched", "rank")
    assert sorted(got.collect()) == sorted(want.collect())


def test_pairs_meet_their_first_entries(spark):
    entities = spark.range(3200).select(F.col("id").alias("entry"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("entity"))
    tokens = spark.range(100).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("token"))
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in (s.apply(i) for s in [spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(s.size()))}
    before = stages()
    out = R.entity_best(tokens, entities, 10)
    assert [r["entry"] for r in out.where("query_id = 7").orderBy("rank").collect()] == list(range(10))
    out.write.format("noop").mode("overwrite").save()
    assert sum(n for k, n in stages().items() if k not in before) < 40_000  # before, 320,000 pairs of a query and an entry in a task's rows or beyond
