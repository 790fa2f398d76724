from pyspark.sql import functions as F

from tidemark.operators.lineage import heads
from tidemark.streaming import jobs


def _folder(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_usage(spark, sf_dir, tmp_path):
    path = _folder(spark, sf_dir, tmp_path)
    jobs.to_memory(jobs.usage(jobs.events(spark, path)), "usage", "complete")
    want = spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"))
    assert spark.table("usage").exceptAll(want).isEmpty() and spark.table("usage").count() == want.count()


def test_windows_drop_repeats(spark, sf_dir, tmp_path):
    path = _folder(spark, sf_dir, tmp_path)
    jobs.to_memory(jobs.windows(jobs.events(spark, path, 9), late="60 days"), "w", "update")
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_lifecycle(spark, tmp_path):
    rows = [(1, 1, "append"), (1, 2, "tombstone"), (2, 1, "append"), (1, 3, "restore")]
    df = spark.createDataFrame(rows, "item long, seq long, action string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.to_memory(jobs.lifecycle(stream), "states", "update")
    assert {(r["item"], r["state"]) for r in spark.table("states").collect()} == {(r["item"], r["state"]) for r in heads(df).collect()}
