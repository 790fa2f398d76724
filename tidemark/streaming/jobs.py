"""Streams of events: usage counts, windows with watermarks, deduplication and lifecycle states.

The windows and the watermark are extensions; the queues that these stand for know only batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from collections.abc import Callable

from tidemark.operators.lineage import NEXT


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files of events as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def usage(stream: DataFrame) -> DataFrame:
    """Uses and last use of each entry, for update or complete mode."""
    return stream.groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"))


def windows(stream: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by tumbling window and kind, each event once, late ones up to the watermark."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def lifecycle(stream: DataFrame) -> DataFrame:
    """State of each item as its events (item, seq, action) come; a batch's events are applied in order."""

    def run(key, batches, state: GroupState):
        now = state.get[0] if state.exists else "none"
        for seq, action in sorted((s, a) for pdf in batches for s, a in zip(pdf["seq"], pdf["action"])):
            now = "active" if now == "none" and action == "append" else NEXT.get((now, action), now)
        state.update((now,))
        yield pd.DataFrame({"item": [key[0]], "state": [now]})

    return stream.groupBy("item").applyInPandasWithState(run, "item long, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def to_memory(df: DataFrame, name: str, mode: str) -> None:
    """Run a stream over all that is there and keep its result as a table of the session; for tests and small results."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def embed_behind(stream: DataFrame, entries: Callable[[], DataFrame], client, model: str, path: str, checkpoint: str):
    """Embed the entries that a stream of names (name) tells of, batch by batch, into a folder of vectors.

    entries: a function that gives the entries as they are now. A batch that is done again writes the same
    file, since its number names the folder; what a stream misses is found by the anti join of missing vectors.
    """
    from tidemark.plugins import embed

    def run(batch: DataFrame, number: int) -> None:
        due = entries().join(batch.select("name").distinct(), "name", "left_semi").select("name", F.concat_ws("\n", F.nullif("trigger", F.lit("")), "content").alias("text"))
        embed(due, "name", "text", client, model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def curate_when_due(stream: DataFrame, due: Callable[[], bool], curate: Callable[[], None], checkpoint: str):
    """Run a curation pass for each batch of notices in which one is due: notices that come together cause one pass."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty() and due():
            curate()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_sessions(stream: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each batch of turns (session, ordinal, speaker, text), blank ones gone, to an ingest function with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        ingest(batch.where(F.trim("text") != ""), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
