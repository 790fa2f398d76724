"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

GRAIN = 1 << 30
FEW = 10_000  # labels whose counts are broadcast


def bounded_sample(rows: DataFrame, key: str, label: str, bound: int, total: int | None = None) -> DataFrame:
    """About `bound` rows at most of each label, chosen by the hash of the key; with total, about that many at most in all.

    Rows of equal keys are taken together. The labels stay in a table: there may be any number of them.
    """
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    kinds = counts.count()
    if total is not None:
        bound = max(1, min(bound, total // max(1, kinds)))
    if kinds <= FEW:  # of a checked size: the rows, which may hold whole texts, stay where they are
        counts = F.broadcast(counts)
    limit = F.least(F.lit(1.0), F.lit(float(bound)) / F.col("__n")) * GRAIN
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(GRAIN))
    return rows.join(counts, F.col(label).eqNullSafe(F.col("__label"))).where(place < limit.cast("long")).select(*rows.columns)


def fold(key: str, parts: int):
    """crc32 of the id as text, modulo the number of parts."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))
