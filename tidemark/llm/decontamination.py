"""Benchmark decontamination by a prefix-filtered set join of word windows, in DataFrame operations only.

An item's windows of WINDOW words are sets of shingles of WIDTH words (fewer, where a window is shorter). A document
contains a window only if it contains all of its shingles, so that under an order of all shingles by rarity, the
prefix that a containment of 1 needs is one shingle: the rarest. Frequencies are counted over all documents, of the
benchmark's shingles only; a window with a shingle that no document has is dropped. Positions of all documents then
meet the windows by their prefix shingle; the place of the shingle in the window and the lengths of window and
document bound where the window may begin, and its words are compared there one by one.

Benchmark tables are broadcast only up to BROADCAST bytes, measured on the written table. Beyond that, the
positions are shuffled to them, each with the few words around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.work import Work

WINDOW = 10
WIDTH = 3
BROADCAST = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern: what separates words of a folded text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; lower() folds more than that, except in ASCII texts."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, GAP), "")


def _keys(words_: Column, at: Column, widths: list[int]) -> Column:
    """Hashes of the shingles of the given widths that begin at a place; null where the words end before."""
    word = [F.get(words_, at + i) for i in range(max(widths))]
    return F.array(*[F.when(word[w - 1].isNotNull(), F.xxhash64(F.lit(w), *word[:w])) for w in widths])


def _positions(docs: DataFrame, widths: list[int], first: int) -> DataFrame:
    """(at, key) of all places of each row's words, with the row's columns; first: -1 for one more, without a key."""
    last = F.greatest(F.size("words") - min(widths), F.lit(-1))
    spots = docs.where(F.size("words") >= min(widths)) if first == 0 else docs
    spots = spots.withColumn("at", F.explode(F.sequence(F.lit(first), last if first else F.greatest(last, F.lit(0)))))
    keys = _keys(F.col("words"), F.col("at"), widths)
    if first:
        keys = F.when(F.col("at") >= 0, keys).otherwise(F.array(F.lit(None).cast("long")))
    if len(widths) == 1:
        return spots.withColumn("key", keys[0])
    return spots.withColumn("key", F.explode(keys))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, window) of a benchmark: window is an array of words, item the id as text ('' if null)."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = source.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))))
    return at.select("item", F.slice("words", F.col("at"), window).alias("window")).distinct()


def _sized(df: DataFrame) -> int:
    """About the bytes of a written table of windows or keys in memory."""
    columns = [F.coalesce(F.octet_length(F.array_join(c, " ")) + 16 * F.size(c), F.lit(0)) if kind.startswith("array") else F.lit(16) for c, kind in df.dtypes]
    return df.select(F.sum(sum(columns, F.lit(64)).cast("long"))).first()[0] or 0


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it is of at most `most` bytes."""
    return F.broadcast(df) if _sized(df) <= most else df


def rarest(work: Work, source: DataFrame, windows: DataFrame, width: int, broadcast: int) -> tuple[DataFrame, list[int]]:
    """The windows (wid, window) with their prefix: key, its place in the window and the width; and all widths."""
    own = F.least(F.size("window"), F.lit(width))
    cut = windows.withColumn("width", own).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("window") - own)))
    widths = sorted(r[0] for r in windows.select(own).distinct().collect())  # at most `width` different ones
    keys = _keys(F.col("window"), F.col("place"), widths)
    cut = work.write(cut.select("wid", "width", "place", F.element_at(keys, F.array_position(F.array(*map(F.lit, widths)), F.col("width")).cast("int")).alias("key")), "shingles")
    wanted = work.write(cut.select("key").distinct(), "wanted")
    met = _positions(source.select("words"), widths, 0).select("key").join(_small(wanted, broadcast), "key")
    counts = work.write(met.groupBy("key").agg(F.count("*").alias("n")), "counts")
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place", "width")
    prefix = cut.join(counts, "key", "left").groupBy("wid").agg(F.min(order).alias("p"))
    return prefix.where("p.n > 0").select("wid", F.col("p.key").alias("key"), F.col("p.place").alias("place")), widths


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, width: int = WIDTH, broadcast: int = BROADCAST) -> DataFrame:
    """What of each document is in the windows of benchmark items.

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of docs; any type of id
    stays. A word is hit if it is inside an occurrence of a window; windows are `window` consecutive words of an item, or all words of a shorter one.
    A null or wordless text has no words and no hits; an item without words has no window. Items whose rows repeat an id are one item with
    several texts; those without an id are one item named ''. Repeated rows of docs, with ids or without, each get their row. Empty
    tables on either side are no error. Other columns are ignored. Texts are taken whole.
    """
    spark = docs.sparkSession
    work = Work(spark, "decontamination")
    text = F.coalesce(F.col(doc_text), F.lit(""))
    # rows of equal ids and texts have equal results; two hashes stand for the text where rows meet
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(text, F.lit(2)).alias("h2"), words(F.col(doc_text)).alias("words"))
    listed = work.write(item_windows(items, item_id, item_text, window), "items")
    windows = work.write(listed.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    if windows.isEmpty():
        spots = source.select("doc_id", "h1", "h2", F.size("words").alias("n_words"), F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("long").alias("wid"))
    else:
        prefix, widths = rarest(work, source, windows, width, broadcast)
        anchors = work.write(prefix.join(windows, "wid").select("key", "place", "wid", "window"), "anchors")
        spots = _occurrences(source, anchors, widths, window, broadcast)
    found = work.write(spots, "found")

    key = ["doc_id", "h1", "h2"]
    hits = work.write(found.where("wid IS NOT NULL").select(*key, "start", "length", "wid").distinct(), "hits")
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    hit_keys = [named, F.col("doc_id").isNull().alias("nameless"), "h1", "h2"]
    by = Window.partitionBy("name", "nameless", "h1", "h2").orderBy("start", "end")
    ends = hits.select(*hit_keys, "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = ends.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    covered = new.groupBy("name", "nameless", "h1", "h2").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = windows.join(listed, "window").select("wid", "item")
    of = hits.select(*hit_keys, "wid").distinct().join(owners, "wid").select("name", "nameless", "h1", "h2", "item").distinct()
    named_items = of.groupBy("name", "nameless", "h1", "h2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    results = covered.join(named_items, ["name", "nameless", "h1", "h2"])
    base = found.where("start = -1").select("doc_id", "n_words", *hit_keys)
    out = base.join(results, ["name", "nameless", "h1", "h2"], "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _occurrences(source: DataFrame, anchors: DataFrame, widths: list[int], window: int, broadcast: int) -> DataFrame:
    """(doc_id, h1, h2, n_words, start, length, wid) of each occurrence of a window, and a row of start -1 for each document."""
    small = _sized(anchors) <= broadcast
    spots = _positions(source, widths, -1 if small else 0).withColumn("n_words", F.size("words"))
    start, length = F.col("at") - F.col("place"), F.size("window")
    if small:  # compared within the scan, against the document's own array
        met, first = spots.join(F.broadcast(anchors), "key", "left"), start
    else:
        reach = F.greatest(F.col("at") - (window - 1), F.lit(0))
        spots = spots.withColumn("from", reach).withColumn("words", F.slice("words", reach + 1, 2 * window - 1))
        met, first = spots.join(anchors, "key"), start - F.col("from")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    equal = F.when(fits, F.slice("words", F.greatest(first, F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("window"))
    columns = ["doc_id", "h1", "h2", "n_words"]
    if small:
        bare = F.col("at") == -1
        return met.where(bare | equal).select(*columns, F.when(bare, -1).otherwise(start).alias("start"), F.when(bare, 0).otherwise(length).alias("length"), "wid")
    documents = source.select(*columns[:3], F.size("words").alias("n_words"), F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("long").alias("wid"))
    return documents.unionByName(met.where(equal).select(*columns, start.alias("start"), length.alias("length"), "wid"))
