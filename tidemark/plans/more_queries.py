"""Scans, candidates, coverage, selections and set operations over all of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import text as T
from tidemark.operators import containment as C, retrieval as R
from tidemark.plans.registry import query

@query("SELECT session, id, ordinal FROM {evidence} WHERE state = 'active'")
def evidence_active(t):
    return t.evidence.where("state = 'active'").select("session", "id", "ordinal")


@query("SELECT l.projection_id, count(*) FILTER (e.state = 'active') AS active, count(*) FILTER (e.state = 'purged') AS purged, count(*) FILTER (e.id IS NULL) AS missing FROM {lineage} l LEFT JOIN {evidence} e ON e.id = l.evidence_id GROUP BY 1")
def evidence_classified(t):
    e = t.evidence.select(F.col("id").alias("evidence_id"), "state")
    return t.lineage.join(e, "evidence_id", "left").groupBy("projection_id").agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "purged").alias("purged"), F.count_if(F.col("state").isNull()).alias("missing"))


@query("SELECT event_type, user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def journal_latest(t):
    from tidemark.sources.files import latest

    return latest(t.events.select("event_type", "user_id", "value", "event_id"), ["event_type", "user_id"], "event_id").select("event_type", "user_id", "value", "event_id")


@query("""WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 4))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 4))) AS w FROM documents), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(count(*) / CAST(any_value(n) AS DOUBLE), 9) AS score FROM q JOIN d USING (w) JOIN n USING (item_id) GROUP BY 1, 2)) WHERE rank <= 5""")
def exact_token_selection(t):
    def items(df, key):
        w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 4))
        return df.select(key, F.explode(w).alias("w"), F.size(w).alias("n"))

    met = items(t.benchmark, "item_id").join(items(t.documents, "doc_id").drop("n"), "w").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("c"))
    hits = R.top(met.withColumn("score", F.round(F.col("c") / F.col("n"), 9)), ["item_id"], [F.desc("score"), "doc_id"], 5)
    return hits.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT a.session, count(DISTINCT a.id) AS gold, count(DISTINCT CASE WHEN p.state = 'active' THEN a.id END) AS covered FROM {evidence} a LEFT JOIN {lineage} l ON l.evidence_id = a.id LEFT JOIN {projections} p ON p.id = l.projection_id WHERE a.speaker = 'user' GROUP BY 1""")
def gold_coverage(t):
    gold = t.evidence.where("speaker = 'user'").select("session", F.col("id").alias("evidence_id"))
    p = t.projections.select(F.col("id").alias("projection_id"), "state")
    j = gold.join(t.lineage, "evidence_id", "left").join(p, "projection_id", "left")
    return j.groupBy("session").agg(F.count_distinct("evidence_id").alias("gold"), F.count_distinct(F.when(F.col("state") == "active", F.col("evidence_id"))).alias("covered"))


@query("""WITH u AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations) SELECT a.conv_id, a.turn AS fact, b.turn AS gold, round(len(list_intersect(a.w, b.w)) / CAST(len(a.w) AS DOUBLE), 6) AS share FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE len(a.w) > 0 AND len(list_intersect(a.w, b.w)) / CAST(len(a.w) AS DOUBLE) >= 0.2""")
def session_containment(t):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != ""))
    u = t.conversations.select(F.col("conv_id").alias("group"), "turn", w.alias("words"))
    met = C.contained(u.withColumnRenamed("turn", "part"), u.withColumnRenamed("turn", "whole"), 0.2).where("part <> whole")
    return met.select(F.col("group").alias("conv_id"), F.col("part").alias("fact"), F.col("whole").alias("gold"), F.round("share", 6).alias("share"))


@query(r"""WITH u AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(CASE WHEN role = 'user' THEN role || ' ' || text ELSE substr(text, 1, 60) END), '[^\p{L}\p{Nd}]+'), lambda x: x <> '' AND NOT list_contains(['a', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'but', 'by', 'for', 'from', 'had', 'has', 'have', 'he', 'her', 'his', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'she', 'that', 'the', 'their', 'them', 'they', 'this', 'to', 'was', 'were', 'will', 'with'], x))) AS w FROM conversations)
SELECT f.conv_id, f.turn AS fact, g.turn AS gold, round(len(list_intersect(f.w, g.w)) / CAST(len(f.w) AS DOUBLE), 6) AS share FROM u f JOIN u g ON f.conv_id = g.conv_id AND f.role <> 'user' AND g.role = 'user' WHERE len(f.w) > 0 AND len(list_intersect(f.w, g.w)) / CAST(len(f.w) AS DOUBLE) >= 0.15""")
def fact_coverage(t):
    """Facts, which here are the beginnings of what is not the user's, and the user's turns, speaker included, that cover them."""
    c = t.conversations.withColumnRenamed("conv_id", "group")
    facts = c.where("role <> 'user'").select("group", F.col("turn").alias("part"), C.content_words(F.substring("text", 1, 60)).alias("words"))
    gold = c.where("role = 'user'").select("group", F.col("turn").alias("whole"), C.content_words(F.concat_ws(" ", "role", "text")).alias("words"))
    met = C.contained(facts, gold, 0.15)
    return met.select(F.col("group").alias("conv_id"), F.col("part").alias("fact"), F.col("whole").alias("gold"), F.round("share", 6).alias("share"))


@query("""SELECT ns, string_agg(line, chr(10) ORDER BY pinned DESC, name) AS export FROM (SELECT ns, pinned, name, '- **' || name || '**: ' || md5(content) AS line FROM {entries}) GROUP BY 1""")
def markdown_export(t):
    line = F.concat(F.lit("- **"), "name", F.lit("**: "), F.md5(F.col("content").cast("binary")))
    rows = F.sort_array(F.collect_list(F.struct((~F.col("pinned")).alias("loose"), "name", line.alias("line"))))
    return t.entries.groupBy("ns").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("export"))


@query("""SELECT ns, CAST(count(*) AS BIGINT) AS entries, count(*) FILTER (NOT pinned) > 80 OR sum(length(name) + length(trigger)) FILTER (NOT pinned) > 2000 AS should_run FROM {entries} GROUP BY 1""")
def curation_trigger(t):
    size = F.sum(F.when(~F.col("pinned"), F.length("name") + F.length("trigger")))
    return t.entries.groupBy("ns").agg(F.count("*").alias("entries"), ((F.count_if(~F.col("pinned")) > 80) | (size > 2000)).alias("should_run"))


@query("""SELECT a.conv_id, a.turn AS earlier, b.turn AS later FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE (contains(' ' || lower(a.text) || ' ', ' not ') OR contains(lower(a.text), 'n''t') OR contains(' ' || lower(a.text) || ' ', ' no ') OR contains(' ' || lower(a.text) || ' ', ' never ')) <> (contains(' ' || lower(b.text) || ' ', ' not ') OR contains(lower(b.text), 'n''t') OR contains(' ' || lower(b.text) || ' ', ' no ') OR contains(' ' || lower(b.text) || ' ', ' never '))
AND len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]{2,}')), list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{2,}')))) >= 2""")
def source_conflicts(t):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    c = t.conversations.select("conv_id", "turn", w.alias("w"), T.negated("text").alias("n"))
    a, b = (c.select("conv_id", F.col("turn").alias(x), F.col("w").alias(f"w{x}"), F.col("n").alias(f"n{x}")) for x in ("earlier", "later"))
    return a.join(b, "conv_id").where((F.col("earlier") < F.col("later")) & (F.col("nearlier") != F.col("nlater")) & (F.size(F.array_intersect("wearlier", "wlater")) >= 2)).select("conv_id", "earlier", "later")


@query("""SELECT conv_id, role, count(*) AS turns, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS places FROM conversations GROUP BY 1, 2""")
def sweep_groups(t):
    return t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("places"))


@query("""SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS running, row_number() OVER (PARTITION BY user_id ORDER BY day) AS t_index FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)""")
def timeline(t):
    g = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    return g.select("user_id", "day", "n", F.sum("n").over(w).alias("running"), F.row_number().over(w).cast("long").alias("t_index"))
