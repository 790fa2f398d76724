"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a hash of its id. A source whose target is e full passes and a rest takes every
document e times, and once more those whose hash lies below a threshold. The threshold is found by
histograms: sizes are summed by source and the next BITS bits of the hash, the bucket in which the
running sum passes the rest is the boundary, and only that bucket is refined by the next bits. After
all LEVELS the boundary is a single hash value, so that nothing is ever sorted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.work import Work

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
BITS, LEVELS = 12, 5  # 60 bits: the first 15 hexadecimal digits of an MD5 sum


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than 0x20 and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of the MD5 sum of the id as text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Target of each source: (source, source_size) gains target.

    Sources in code point order, null last, weigh the given weights, repeating, and share the sum of
    all sizes; none gets more than `most` times its size, and the excess goes to the others by weight
    until none is above. That is filling to one level: in order of most * size / weight, sources are
    full up to the first for which the rest, shared by weight, doesn't fill it. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("before", F.sum("cap").over(by_level) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(every) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("open"), F.struct("before", "level"))).over(every)["level"]
    return filled.withColumn("final", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Of each source (source, size and hash of each document given) its target, full passes and threshold.

    Returns (source, source_size, target, full, threshold, with_edge): documents are taken full times, and
    once more where their hash is below the threshold, or equals it and with_edge holds, that is where
    taking the boundary comes nearer to the target than leaving it.
    """
    work = Work(rows.sparkSession, "mixing")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    aims = work.write(aims.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "targets")

    # per source: the bits of the boundary so far, and the words below it
    edge = aims.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = rows if level == 1 else rows.join(_renamed(edge), F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("hash", shift + BITS) == F.col("edge_prefix"))).select("source", "size", "hash")
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        placed = sums.join(_renamed(edge), F.col("source").eqNullSafe(F.col("edge_source")))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = placed.withColumn("upto", F.col("edge_base") + F.sum("words").over(run))
        first = placed.where("upto > edge_rest").groupBy("source").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"), F.first("edge_rest").alias("rest"))
        edge = first.select("source", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("base"), F.col("b.words").alias("words"))
        edge = work.write(edge, f"edge{level}")  # a row for each source
    edge = edge.withColumn("with_edge", F.col("base") + F.col("words") - F.col("rest") < F.col("rest") - F.col("base"))
    plan = aims.join(edge.select(F.col("source").alias("edge_source"), F.col("prefix").alias("threshold"), "with_edge"), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source", "rest")
    return work.write(plan, "plan")


def _passes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan's columns and passes, how often each row (with source and hash) is taken."""
    named = plan.withColumnRenamed("source", "plan_source")
    more = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("with_edge"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("passes", F.col("full") + F.coalesce(more, F.lit(False)).cast("int"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash"))
    return Work(docs.sparkSession, "sized").write(rows, "rows")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """How many words of each document a mix of the sources to their target weights takes.

    Returns (doc_id, size, source, source_size, target, passes, taken), one row per row of docs: size
    is the number of words (null: 0), passes how often the document is taken, taken = size * passes.
    A null source is a source of its own, last in order. Rows with equal ids share a hash and are taken
    alike; an empty table gives an empty result. The mix depends on ids and sizes only: reruns agree.
    """
    rows = _sized(docs, id_col, source_col, text_col)
    out = _passes(rows, plan_mix(rows, weights, most))
    return out.select("doc_id", "size", "source", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as the mix takes it."""
    plan = plan_mix(_sized(docs, id_col, source_col, text_col), weights, most).select(*[F.col(c).alias(f"__{c}") for c in ("source", "full", "threshold", "with_edge")])
    own = id_hash(docs[id_col])
    more = (own < F.col("__threshold")) | ((own == F.col("__threshold")) & F.col("__with_edge"))
    passes = F.col("__full") + F.coalesce(more, F.lit(False)).cast("int")
    mixed = docs.join(plan, docs[source_col].eqNullSafe(F.col("__source"))).withColumn("__passes", passes).where("__passes > 0")
    return mixed.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__passes")))).select(*[docs[c] for c in docs.columns])


def _renamed(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("source").alias("edge_source"), F.col("rest").alias("edge_rest"), F.col("prefix").alias("edge_prefix"), F.col("base").alias("edge_base"))
