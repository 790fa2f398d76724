"""Document fingerprints: canonical exact digests, in DataFrame operations only.

The canonical form of a text is its NFKC form with case folded, normalised again, with each run of
white space folded to one space and none at the ends. Its fingerprint is two 64-bit xxhash values
of different prefixes as 32 hexadecimal digits. Texts with equal fingerprints are compared by the
bytes of their canonical forms before they count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.work import Work

RANGES = 1024
ROWS = 512
MARK_BITS = 24  # of the bounded bitmap of ids in shared buckets: 512 rows of 4 kB


def _icu(of: str, method: str, text: Column, option: bool) -> Column:
    return F.call_function("reflect", F.lit(f"com.ibm.icu.{of}"), F.lit(method), text, F.lit(option))


def folded(text: Column) -> Column:
    """NFKC form with full case folding, normalised again; for ASCII texts that is lower case."""
    compose = lambda x: _icu("text.Normalizer", "compose", x, True)
    whole = compose(_icu("lang.UCharacter", "foldCase", compose(text), True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(whole)


def canonical(text: Column) -> Column:
    """Normalised, case and white space folded; null is the empty text."""
    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[\s\p{Z}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash of a canonical text, as 32 hexadecimal digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """Groups of documents of one canonical text: (doc_id, fingerprint, group_id), one row per row of docs.

    group_id is the smallest id among documents whose canonical texts are equal byte for byte. Buckets of
    one document need no comparison; texts of the others alone are moved, once per task and distinct
    text. Null and empty texts form one group. A row without an id has a null group_id where it is alone.
    Where two texts of one id have one fingerprint but other bytes, both rows have the least of their groups.
    prints: written rows with the columns doc_id and fingerprint, which are returned with group_id added.
    """
    spark = docs.sparkSession
    work = Work(spark, "groups")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if prints is None:
        prints = work.write(source.select("doc_id", digest(canonical(F.col("text"))).alias("fingerprint")), "prints")
    buckets = prints.groupBy("fingerprint").agg(F.count("*").alias("k"), F.min("doc_id").alias("least")).where("k > 1")
    # a table of its own: joins with it share no exchange with an aggregate, so that a hot fingerprint can be split
    buckets = work.write(buckets.select(F.col("fingerprint").alias("print"), "least"), "buckets")
    # which ids share a bucket, as a bitmap of fixed size by hashed id; a false hit only costs a comparison
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS))
    shared = prints.join(buckets, F.col("fingerprint") == F.col("print"), "left_semi")
    marks = shared.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    marks = work.write(marks, "marks")  # at most 2^MARK_BITS / 32768 rows of 4 kB
    spot = source.withColumn("at", at).withColumn("page_of", F.bitmap_bucket_number("at")).withColumn("bit", F.bitmap_bit_position("at"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    hit = spot.join(F.broadcast(marks), F.col("page_of") == F.col("page")).where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0)
    texts = hit.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    compared = work.write(texts.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id")).select("fingerprint", "group_id", F.sha2("canon", 512).alias("bytes")), "compared")
    clash = compared.groupBy("fingerprint").agg(F.count("*").alias("texts")).where("texts > 1").select("fingerprint")
    placed = prints.join(buckets, F.col("fingerprint") == F.col("print"), "left").withColumn("group_id", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("least"))).drop("print", "least")
    if clash.isEmpty():
        return placed
    apart = texts.join(clash, "fingerprint").withColumn("bytes", F.sha2("canon", 512)).join(compared, ["fingerprint", "bytes"])
    apart = apart.groupBy(F.col("doc_id").alias("own"), F.col("fingerprint").alias("print")).agg(F.min("group_id").alias("other"), F.lit(True).alias("clashes"))
    placed = placed.join(apart, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("fingerprint") == F.col("print")), "left")
    return placed.withColumn("group_id", F.when(F.col("clashes"), F.col("other")).otherwise(F.col("group_id"))).drop("own", "print", "other", "clashes")


def _buckets(ids: DataFrame) -> tuple[Column, Column]:
    """Range and bucket of doc_id, both rising with it; a bucket holds about ROWS ids, null ids are one bucket below all."""
    n, least, most = ids.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return F.lit(-1).cast("long"), F.lit(-1).cast("long")
    marks = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))
    lows = sorted({least, *map(int, marks)})
    parts = max(1, -(-n // (len(lows) * ROWS)))
    widths = [max(1, -(-(high - low) // parts)) for low, high in zip(lows, [*lows[1:], most + 1])]
    # two steps of at most sqrt(RANGES) comparisons
    step = max(1, int(len(lows) ** 0.5))
    groups = [lows[i : i + step] for i in range(0, len(lows), step)]
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("doc_id")))
    whole = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    each = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    top = upto(whole)
    nth = ((top - 1) * step + upto(F.element_at(each, top))).cast("int")
    low = F.element_at(F.array(*[F.lit(x).cast("long") for x in lows]), nth)
    width = F.element_at(F.array(*[F.lit(x).cast("long") for x in widths]), nth)
    null = F.col("doc_id").isNull()
    return F.when(null, -1).otherwise(nth.cast("long")), F.when(null, -1).otherwise(nth.cast("long") * (1 << 32) + F.floor((F.col("doc_id") - low) / width))


def with_next(docs: DataFrame, values: list[str]) -> DataFrame:
    """Add next_<value> for each value: that of the next row in descending doc_id; after the last comes the first.

    Ids are cut at quantiles into ranges, and those evenly into buckets of about ROWS ids; the first rows
    of each bucket are also sent to the bucket before it, so that one shuffle by bucket finds every successor.
    Rows of equal ids go in order of the first value; rows without an id come last, as one bucket, and so do the rows of
    one repeated id: a table that is for the most part of these is sorted by one task there.
    """
    work = Work(docs.sparkSession, "successors")
    area, bucket = _buckets(docs.select("doc_id"))
    heads = docs.select("doc_id", area.alias("area"), bucket.alias("bucket")).groupBy("area", "bucket").agg(F.max("doc_id").alias("head"))
    heads = work.write(heads, "buckets")
    rising = Window.partitionBy("area").orderBy("bucket")
    areas = heads.groupBy("area").agg(F.min("bucket").alias("lowest"))  # RANGES rows at most
    areas = areas.select(F.col("area").alias("own"), F.lead("lowest").over(Window.orderBy("area")).alias("over"), F.min("lowest").over(Window.partitionBy()).alias("bottom"))
    to = heads.withColumn("above", F.lead("bucket").over(rising)).join(F.broadcast(areas), F.col("area") == F.col("own"))
    to = work.write(to.select(F.col("bucket").alias("from"), "head", F.coalesce("above", "over", "bottom").alias("to")), "heads")
    # the written table is small: the planner broadcasts it while it is below the session's threshold
    rows = docs.withColumn("bucket", bucket).join(to, (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own, sent = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("sent")), F.struct(F.col("to").alias("at"), F.lit(1).alias("sent"))
    rows = rows.select(*docs.columns, F.inline(F.when(F.col("to").isNotNull(), F.array(own, sent)).otherwise(F.array(own))))
    order = Window.partitionBy("at").orderBy("sent", F.col("doc_id").desc_nulls_last(), values[0])
    after = F.lead(F.struct(*values)).over(order)  # one window for all: one shuffle
    return rows.withColumn("next", after).where("sent = 0").select(*docs.columns, *[F.col(f"next.{v}").alias(f"next_{v}") for v in values])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of an edited text, their likeness, and the group of equal texts.

    The edited text of a row has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next row's text, in descending id (after the last: the first). Returns (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id), one row per row of
    docs. An exact digest knows equal or not: likeness is 1 where fingerprints and canonical bytes are equal,
    else 0. Null texts are empty; a lone row is its own successor; rows of equal ids have one group_id each,
    the least of their texts' groups.
    """
    work = Work(docs.sparkSession, "fingerprints")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one canonical form of each text and one of each edited text: the next text's fingerprint comes with it
    source = source.withColumn("fingerprint", digest(canonical(F.col("text"))))
    rows = with_next(source, ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, CAST(n_chars AS INT) - cut)"), F.expr("left(next_text, cut)")))
    rows = rows.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))
    # bytes are compared only where fingerprints are equal
    near = lambda other, print_: F.when(F.col("fingerprint") == F.col(print_), (canonical(F.col("text")) == canonical(F.col(other))).cast("double")).otherwise(0.0)
    out = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited", "edited_fingerprint").alias("near_edited"), near("next_text", "next_fingerprint").alias("near_next"))
    return exact_groups(source, prints=work.write(out, "prints"))
