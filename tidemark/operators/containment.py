"""Which texts of a group hold enough of the words of others: containment joins through rare words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.work import Work

# Words that don't count.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its",
    "of", "on", "or", "she", "that", "the", "their", "them", "they", "this", "to", "was", "were", "will", "with",
)


def content_words(text: Column) -> Column:
    """The distinct words of letters and digits of a text, in lower case, without stop words; null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_except(parts, F.array(F.lit(""), *map(F.lit, STOP_WORDS)))


def contained(parts: DataFrame, wholes: DataFrame, least: float) -> DataFrame:
    """Pairs of one group of which a share of `least` or more of the part's words are in the whole: (group, part, whole, share).

    parts: (group, part, words), wholes: (group, whole, words), words being distinct. Of n words all but n - ceil(least n) must be met, so that one
    of any n - ceil(least n) + 1 of them is: the rarest among the group's wholes are looked up, words that no whole has are not. What meets is
    compared whole. A group's texts are not all compared with each other, and no group is gathered. Parts without words are in no pair.
    """
    work = Work(parts.sparkSession, "containment")
    a = work.write(parts.select("group", "part", F.col("words").alias("wa")).where("size(wa) > 0"), "parts")
    b = work.write(wholes.select("group", "whole", F.col("words").alias("wb")), "wholes")
    posted = b.select("group", "whole", F.explode("wb").alias("word"))
    often = posted.groupBy("group", "word").agg(F.count("*").alias("k"))
    asked = a.select("group", "part", F.size("wa").alias("n"), F.explode("wa").alias("word")).join(often, ["group", "word"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("group", "part").orderBy("k", "word"))
    prefix = asked.withColumn("nth", first).where((F.col("nth") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1) & (F.col("k") > 0)).select("group", "part", "word")
    near = work.write(prefix.join(posted, ["group", "word"]).select("group", "part", "whole").distinct(), "near")
    share = F.size(F.array_intersect("wa", "wb")) / F.size("wa")
    return near.join(a, ["group", "part"]).join(b, ["group", "whole"]).withColumn("share", share).where(F.col("share") >= least).select("group", "part", "whole", "share")
