"""Lifecycle requests of evidence: states with revisions that remember the requests which made them, alike for a batch and a stream.

Heads: (item, state, revision, recorded), recorded being a map of request ids to actions. Requests: (item, seq, action, request_id,
revision); request_id may be null or empty, revision, the one that a request was made on, may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.lineage import NEXT

HEADS = "item long, state string, revision long, recorded map<string,string>"


def _outcome(head, r) -> Column:
    """What becomes of a request: applied, repeated, conflict (its id stands for another action), purged, stale (another revision), missing or refused."""
    known = F.element_at(head["recorded"], r["request_id"])
    legal = F.lit(False)
    for before, action in NEXT:
        legal = legal | ((head["state"] == before) & (r["action"] == action))
    gone, new = head["state"] == "purged", head["state"] == "none"
    return (
        F.when(new & (r["action"] == "append"), "applied").when(new, "missing")
        .when(gone, F.when(r["action"] == "purge", "repeated").otherwise("purged"))
        .when((r["request_id"] != "") & known.isNotNull(), F.when(known == r["action"], "repeated").otherwise("conflict"))
        .when(r["revision"].isNotNull() & (r["revision"] != head["revision"]), "stale")
        .when(legal, "applied").otherwise("refused")
    )


def _next(head, r) -> Column:
    out = F.when((head["state"] == "none") & (r["action"] == "append"), "active")
    for (before, action), after in NEXT.items():
        out = out.when((head["state"] == before) & (r["action"] == action), after)
    return out.otherwise(head["state"])


def applied(heads: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads after requests, which act on each item in order of seq, and the outcome of each request: (item, seq, outcome, revision).

    An append makes the head of an item that has none. A request whose id was recorded with the same action is repeated and changes
    nothing, so that a batch may come twice. Requests of one item are folded in one row: an item has few.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    queue = requests.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), text("action"), text("request_id"), F.col("revision").cast("long").alias("revision")))).alias("queue"))
    told = "array<struct<seq:bigint,outcome:string,revision:bigint>>"
    start = F.struct(F.coalesce("state", F.lit("none")).alias("state"), F.coalesce("revision", F.lit(0).cast("long")).alias("revision"), F.coalesce("recorded", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("recorded"), F.array().cast(told).alias("told"))

    def step(head, r):
        outcome = _outcome(head, r)
        did = outcome == "applied"
        revision = head["revision"] + did.cast("long")
        recorded = F.when(did & (r["request_id"] != ""), F.map_concat(head["recorded"], F.create_map(r["request_id"], r["action"]))).otherwise(head["recorded"])
        return F.struct(F.when(did, _next(head, r)).otherwise(head["state"]).alias("state"), revision.alias("revision"), recorded.alias("recorded"), F.concat(head["told"], F.array(F.struct(r["seq"].alias("seq"), outcome.alias("outcome"), revision.alias("revision")))).alias("told"))

    both = queue.join(heads, "item", "full_outer").withColumn("x", F.when(F.col("queue").isNotNull(), F.aggregate("queue", start, step)))
    after = both.select("item", F.coalesce("x.state", "state").alias("state"), F.coalesce("x.revision", "revision").alias("revision"), F.coalesce("x.recorded", "recorded").alias("recorded")).where("state <> 'none'")
    outcomes = both.where("x IS NOT NULL").select("item", F.inline("x.told"))
    return after, outcomes


def follow(stream: DataFrame, folder: str, checkpoint: str):
    """Apply a stream of requests batch by batch: heads after batch n are in folder/heads-n, outcomes in folder/outcomes-n.

    A batch that is run again, after a failure, reads the heads before it and writes the same tables again.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(HEADS).parquet(f"{folder}/heads-{n - 1}") if n else spark.createDataFrame([], HEADS)
        batch = batch.persist()
        after, outcomes = applied(before, batch)
        outcomes.write.mode("overwrite").parquet(f"{folder}/outcomes-{n}")
        after.write.mode("overwrite").parquet(f"{folder}/heads-{n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, batches: int) -> DataFrame:
    """Heads after that many batches."""
    return spark.read.schema(HEADS).parquet(f"{folder}/heads-{batches - 1}")
