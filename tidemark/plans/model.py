"""The memory model's tables, made of the driver's: in DataFrames, and in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Each in DuckDB SQL; later ones may use earlier ones.
SQL: dict[str, str] = {}

SQL["entries"] = """SELECT lang AS ns, doc_id AS id, 'doc-' || doc_id AS name, substr(text, 1, 60) AS trigger, text AS content, doc_id % 50 = 0 AS pinned,
 CASE WHEN doc_id % 3 = 0 THEN 'evergreen' ELSE 'volatile' END AS durability, source AS category, CAST(length(text) AS BIGINT) AS char_count, doc_id % 7 AS hit_count,
 TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) AS created_at, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 + doc_id % 11 AS INTEGER)) AS updated_at FROM documents"""
SQL["evidence"] = """SELECT conv_id AS session, conv_id || ':' || turn AS id, CAST(turn AS BIGINT) AS ordinal, role AS speaker, text AS content,
 CASE (conv_id * 7 + turn) % 10 WHEN 0 THEN 'tombstoned' WHEN 1 THEN 'purged' ELSE 'active' END AS state FROM conversations"""
SQL["asked"] = """SELECT conv_id AS query_id, 'Compare ' || array_to_string(regexp_split_to_array(arg_min(text, turn), '[ \\t\\n]+')[1:2], ' ') || ' and then ' || array_to_string(regexp_split_to_array(arg_max(text, turn), '[ \\t\\n]+')[2:3], ' ') AS query FROM conversations GROUP BY 1"""
SQL["projections"] = """SELECT conv_id AS session, conv_id || '/' || (turn // 2) AS id, CASE WHEN (conv_id + turn // 2) % 6 = 0 THEN 'stale' ELSE 'active' END AS state,
 CASE WHEN (turn // 2) % 3 = 2 THEN 'episode' ELSE 'atomic_fact' END AS kind, min(turn) AS first_turn FROM conversations GROUP BY ALL"""
SQL["lineage"] = """SELECT conv_id || '/' || (turn // 2) AS projection_id, CAST(turn % 2 AS BIGINT) AS source_order, conv_id || ':' || turn AS evidence_id FROM conversations
 UNION ALL SELECT conv_id || '/' || (turn // 2) AS projection_id, CAST(2 AS BIGINT) AS source_order, conv_id || ':' || (turn - 2) AS evidence_id FROM conversations WHERE turn % 4 = 2"""
SQL["runs"] = """SELECT d.doc_id AS question_id, d.lang AS category, l.quality = 1 AS control, l.toxic = 0 AS treatment, d.n_chars AS tokens, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS score
 FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
SQL["entities"] = """SELECT DISTINCT o_orderkey AS entry, lower(trim(p_brand)) || ' ' || p_size AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"""
SQL["queries"] = """SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings WHERE vec_id % 100 = 0"""
SQL["questions"] = """SELECT vec_id AS query_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{5,}')[1:2], ' ') || coalesce(' ' || nullif(regexp_extract(text, '[A-Za-z]{12,}'), ''), '') AS text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0
 UNION ALL SELECT * FROM (VALUES (1000001, 'anan'), (1000002, 'don''t stop'), (1000003, '東京 the'), (1000004, '日本語版 the'), (1000005, 'ouou!? The'), (1000006, ''), (1000007, 'ab')) x(query_id, text)"""
SQL["doc_entities"] = """SELECT DISTINCT 'doc-' || doc_id AS entry, lower(w) AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{12,}')) AS w FROM documents)"""
SQL["tokens"] = """SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS token FROM documents"""


def entries(t) -> DataFrame:
    d = t.documents
    day = lambda n: F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST({n} AS INT))")
    return d.select(
        F.col("lang").alias("ns"), F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("name"), F.substring("text", 1, 60).alias("trigger"), F.col("text").alias("content"),
        (F.col("doc_id") % 50 == 0).alias("pinned"), F.when(F.col("doc_id") % 3 == 0, "evergreen").otherwise("volatile").alias("durability"), F.col("source").alias("category"),
        F.length("text").cast("long").alias("char_count"), (F.col("doc_id") % 7).alias("hit_count"), day("doc_id % 700").alias("created_at"), day("doc_id % 700 + doc_id % 11").alias("updated_at"),
    )


def evidence(t) -> DataFrame:
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 10
    return t.conversations.select(
        F.col("conv_id").alias("session"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("ordinal"), F.col("role").alias("speaker"), F.col("text").alias("content"),
        F.when(kind == 0, "tombstoned").when(kind == 1, "purged").otherwise("active").alias("state"),
    )


def asked(t) -> DataFrame:
    """A question for each session, of words of its first and last turn."""
    two = lambda text, k: F.array_join(F.slice(F.split(text, r"[ \t\n]+"), k, 2), " ")
    ends = t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    return ends.select("query_id", F.concat(F.lit("Compare "), two("a", 1), F.lit(" and then "), two("b", 2)).alias("query"))


def candidates_all(t) -> DataFrame:
    """Every turn of a session as a candidate of its question."""
    return t.evidence.select(
        F.col("session").alias("query_id"), F.concat(F.lit("c"), "ordinal").alias("id"), F.lit("raw_turn").alias("kind"), (F.col("ordinal") + 1).cast("int").alias("rank"), F.lit(1.0).alias("score"), F.col("content").alias("text"),
        F.sha2("content", 256).alias("text_digest"), F.array("id").alias("source_ids"), F.col("ordinal").alias("place"), "state",
    )


def candidates(t) -> DataFrame:
    """As candidates_all, of active turns alone."""
    return t.candidates_all.where("state = 'active'").drop("state")


def sources(t) -> DataFrame:
    return t.evidence.select("id", "content", F.sha2("content", 256).alias("digest"), F.lit(None).cast("timestamp").alias("occurred_at"), "state")


def projections(t) -> DataFrame:
    half = F.expr("turn div 2")
    rows = t.conversations.select(
        F.col("conv_id").alias("session"), F.concat_ws("/", "conv_id", half).alias("id"), F.when((F.col("conv_id") + half) % 6 == 0, "stale").otherwise("active").alias("state"),
        F.when(half % 3 == 2, "episode").otherwise("atomic_fact").alias("kind"), "turn",
    )
    return rows.groupBy("session", "id", "state", "kind").agg(F.min("turn").alias("first_turn"))


def lineage(t) -> DataFrame:
    c = t.conversations
    own = F.concat_ws("/", "conv_id", F.expr("turn div 2")).alias("projection_id")
    one = c.select(own, (F.col("turn") % 2).alias("source_order"), F.concat_ws(":", "conv_id", "turn").alias("evidence_id"))
    two = c.where("turn % 4 = 2").select(own, F.lit(2).cast("long").alias("source_order"), F.concat_ws(":", "conv_id", F.col("turn") - 2).alias("evidence_id"))
    return one.union(two)


def runs(t) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("control"), (F.col("toxic") == 0).alias("treatment"),
        F.col("n_chars").alias("tokens"), (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("score"),
    )


LINES = 1 << 19  # lines of orders in a task


def entities(t) -> DataFrame:
    """Dealt by entry, to as many tasks as the lines need, so that what a task holds does not grow with the table."""
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // LINES))
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", F.concat_ws(" ", F.lower(F.trim("p_brand")), "p_size").alias("entity"))
    lines = named.repartition(parts, "l_orderkey").join(t.orders.select("o_orderkey").repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_orderkey").alias("entry"), "entity").distinct()


def queries(t) -> DataFrame:
    """Every hundredth vector."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))


#: Questions of the forms that the keyword plan tells apart: overlapping, illegal and short runs, CJK, marks, none.
ODD_QUESTIONS = [(1000001, "anan"), (1000002, "don't stop"), (1000003, "東京 the"), (1000004, "日本語版 the"), (1000005, "ouou!? The"), (1000006, ""), (1000007, "ab")]


def questions(t) -> DataFrame:
    """A question for every hundredth id, of words of its document, and the odd ones."""
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    words = F.concat_ws(" ", F.array_join(F.slice(found("[A-Za-z]{5,}"), 1, 2), " "), F.try_element_at(found("[A-Za-z]{12,}"), F.lit(1)))
    own = t.queries.select("query_id").join(t.documents.select(F.col("doc_id").alias("query_id"), "text"), "query_id")
    # an aggregate, below which no filter on the words goes: it would read the words of all documents
    own = own.groupBy("query_id").agg(F.max("text").alias("text")).select("query_id", words.alias("text"))
    return own.union(t.spark.createDataFrame(ODD_QUESTIONS, "query_id long, text string"))


def doc_entities(t) -> DataFrame:
    w = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{12,}"), F.lit(0)))
    return t.documents.select(F.concat(F.lit("doc-"), "doc_id").alias("entry"), w.alias("raw")).select("entry", F.lower("raw").alias("entity")).distinct().withColumn("raw", F.col("entity"))


def tokens(t) -> DataFrame:
    return t.documents.select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))).alias("token"))
