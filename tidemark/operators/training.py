"""Training data of the retrieval models: samples, hard negatives, contamination, audits and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import ascii_bounds
from tidemark.operators.neardup import text_grams

# What an audit allows, and patterns of personal data and of times.
LICENSES = ("cc-by-4.0-synthetic", "apache-2.0", "mit")
SPLITS = ("train", "validation")
REQUIRED = ("id", "conversation_id", "query", "query_date", "category", "candidates", "sources", "target", "data_source", "license", "split", "build_version", "content_digest")
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b(?:\d{3}-?){2}\d{4}\b"
NAMESPACE = r"(?i)\bnamespace\b"
TIME_SIGNALS = (
    r"\b\d{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*(\s+\d{2,4})?\b", r"\b(january|february|march|april|june|july|august|september|october|november|december)\s+\d{1,2}(,\s+\d{4})?\b", r"\b\d{4}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b(yesterday|today|tomorrow|tonight)\b",
    r"\b(last|this|next|past|previous|upcoming)\s+(week|month|year|weekend|friday|saturday|sunday|monday|tuesday|wednesday|thursday)\b", r"\b\d+\s+(days?|weeks?|months?|years?)\s+ago\b", r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\b(ago|since|until|after|before|back then|recently|last night|this morning)\b",
)


def time_signal(text: Column) -> Column:
    return text.rlike(ascii_bounds("(?i)" + "|".join(TIME_SIGNALS)))


def alnum_words(text: Column, least: int = 1) -> Column:
    """Distinct runs of a-z and digits of at least that length, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def audit(rows: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Problems of training records (id, ...): (id, problem) of missing fields, licenses, splits, personal data and namespaces.

    Columns that a table lacks count as missing in each of its rows.
    """
    said = F.concat_ws("\n", *[F.col(c).cast("string") for c in ("query", "target") if c in rows.columns])
    checks = [F.when(F.lit(True) if c not in rows.columns else F.col(c).isNull(), f"missing {c}") for c in columns]
    known = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False)) if c in rows.columns else F.lit(False)
    checks += [F.when(known("license", LICENSES), "license"), F.when(known("split", SPLITS), "split"), F.when(said.rlike(ascii_bounds(PERSONAL)), "personal data"), F.when(said.rlike(ascii_bounds(NAMESPACE)), "namespace")]
    return rows.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def contaminated(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, n: int = 20) -> DataFrame:
    """Documents that share character n-grams with benchmark items: (key, item, shared), white space folded, lower case.

    Grams are hashed in place; the benchmark's are few against the documents' and left to the planner to broadcast, so that
    documents' grams that are in no item end where they are made.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    own = text_grams(docs.select(key, norm(F.col(text)).alias("x")), key, "x", n, "none").select(key, F.explode("grams").alias("g"))
    theirs = text_grams(benchmark.select(item, norm(F.col(item_text)).alias("x")), item, "x", n, "none").select(item, F.explode("grams").alias("g"))
    return own.join(theirs, "g").groupBy(key, item).agg(F.count("*").alias("shared"))


def hard_negatives(pool: DataFrame, positives: DataFrame, queries: DataFrame, seed: str, most: int, window_days: int, overlap: int, least: float = 0.7) -> DataFrame:
    """Negatives of each query from its own dialogue: (query_id, doc_id, kind, nth), kind in-dialogue or temporal-hard.

    pool: (dialogue, doc_id, text, date); positives: (query_id, doc_id, text); queries: (query_id, dialogue, text, date, temporal).
    Positives and what is alike one (word Jaccard above least) are out. Temporal-hard ones speak of a time, share words
    with the query, and lie more than window_days from its date. Choices are by the hash of the seed: reruns agree.
    """
    docs = pool.select("dialogue", "doc_id", F.col("date").alias("of"), alnum_words(F.col("text")).alias("w"), alnum_words(F.col("text"), 3).alias("long"), time_signal(F.col("text")).alias("timely"))
    q = queries.select("query_id", "dialogue", F.col("date").alias("at"), "temporal", alnum_words(F.col("text"), 3).alias("asked"))
    met = q.join(docs, "dialogue").join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    own = positives.select("query_id", alnum_words(F.col("text")).alias("p")).groupBy("query_id").agg(F.collect_list("p").alias("positive"))  # a query's positives are few
    same = lambda p: F.size(F.array_intersect(F.col("w"), p))
    alike = F.exists("positive", lambda p: (F.size(p) > 0) & (F.size("w") > 0) & (same(p) / (F.size("w") + F.size(p) - same(p)) > least))
    met = met.join(own, "query_id").where(~alike)
    far = F.col("at").isNull() | F.col("of").isNull() | (F.abs(F.datediff("at", "of")) > window_days)
    hard = F.col("temporal") & F.col("timely") & far & (F.size(F.array_intersect("asked", "long")) >= overlap)
    rows = met.select("query_id", "doc_id", F.explode(F.array_compact(F.array(F.lit("in-dialogue"), F.when(hard, "temporal-hard")))).alias("kind"))
    order = Window.partitionBy("query_id", "kind").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "kind", "query_id", "doc_id"), 256), "doc_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def stratified(rows: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows: an equal share of each stratum by the hash of the key, and the next ones of any where strata are short."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    strata = rows.select(*by).distinct().count()
    share = max(1, n // max(1, strata))
    ranked = rows.withColumn("__h", digest).withColumn("__own", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key)))
    first, rest = ranked.where(F.col("__own") <= share), ranked.where(F.col("__own") > share)
    # whose place is below n in all: those of a stratum's share first, then the others; a sorted limit keeps n rows of each task
    both = first.withColumn("__tier", F.lit(0)).union(rest.withColumn("__tier", F.lit(1)))
    return both.orderBy("__tier", "__h", key).limit(n).drop("__h", "__own", "__tier")


def joint_label(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two labellers' needs (key, entities, times, operands, count, state) and actions (array of kind, candidate) as one: (key, ..., changed).

    Entities and times unite, the longer list of operands stays, a known count and state win, actions unite in order.
    """
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key]), key)
    union = lambda c: F.array_sort(F.array_union(f"a_{c}", f"b_{c}")).alias(c)
    longer = F.when(F.size("a_operands") >= F.size("b_operands"), F.col("a_operands")).otherwise(F.col("b_operands"))
    out = x.select(key, union("entities"), union("times"), longer.alias("operands"), F.coalesce("a_count", "b_count").alias("count"), F.coalesce(F.nullif("a_state", F.lit("")), F.col("b_state")).alias("state"), F.array_union("a_actions", "b_actions").alias("actions"), *[f"a_{c}" for c in a.columns if c != key], *[f"b_{c}" for c in b.columns if c != key])
    parts = [c for c in a.columns if c != key]
    changed = F.lit(False)
    for side in "ab":
        for c in parts:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"{side}_{c}"))
    return out.withColumn("changed", changed).select(key, *parts, "changed")


def label_entities(text: Column, stop: tuple[str, ...]) -> Column:
    """Quoted phrases and capitalised words, without stop words, numbers and dates; sorted."""
    plain = lambda s: ~s.rlike(r"^\s*\d+(\.\d+)?\s*$") & ~s.rlike(r"^\s*(19|20)\d{2}([-/]\d{1,2}([-/]\d{1,2})?)?\s*$") & (s != "")
    quoted = F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), F.trim), plain)
    words = F.filter(F.split(text, "[^A-Za-z0-9']+"), lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(*stop) & ~w.rlike(r"^\d+$"))
    return F.array_sort(F.array_distinct(F.concat(quoted, words)))
