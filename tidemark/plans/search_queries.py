"""The search as a whole and its parts, events, training data and selections over documents and conversations, against SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from tidemark.operators import events as E, search as S, selection as X, training as N
from tidemark.plans.registry import query
from tidemark.plans.retrieval_queries import _SIGNALS
from tidemark.work import Work


def _memory(t):
    """Documents as a memory: a year of events, every sixth fact stale, entities, one alias each, vectors of two models, every fifth one a shadow."""
    d = t.documents
    name = F.concat(F.lit("doc-"), "doc_id").alias("name")
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 365 AS INT))")
    entries = d.select(name, F.col("doc_id").cast("string").alias("id"), F.lit("").alias("trigger"), F.col("text").alias("content"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id AS INT))").alias("updated_at"), F.when(F.col("doc_id") % 10 != 0, day).alias("event_start"),
                       F.when(F.col("doc_id") % 10 != 0, day).alias("event_end"), F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("doc-"), F.col("doc_id") + 1)).alias("superseded_by"))
    shadow = F.col("vec_id") % 5 == 4
    named = F.concat(F.lit("doc-"), F.when(shadow, F.col("vec_id") - 1).otherwise(F.col("vec_id")), F.when(shadow, "#alias").otherwise(""))
    vectors = t.embeddings.select(named.alias("name"), F.when(F.col("vec_id") % 11 == 3, "old").otherwise("new").alias("model"), F.col("embedding").alias("vec"))
    projections = d.select(F.concat(F.lit("p"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("object_key"), F.when(F.col("doc_id") % 6 == 0, "stale").otherwise("active").alias("state"), F.lit("atomic_fact").alias("kind"))
    aliases = d.select(name.alias("entry"), F.concat(F.lit("aka "), F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("text"))
    return {"entries": entries, "vectors": vectors, "entities": t.doc_entities, "projections": projections, "aliases": aliases, "keywords": t.keywords("memory", ("name", "trigger", "content"))}


def _queries(t):
    """Every question, and every vector query: one of either has no vector, or no text and so no results."""
    q = t.questions.join(t.queries, "query_id", "full")
    return q.select("query_id", "text", "vec", F.lit("2024-06-15").cast("date").alias("now"), F.lit(8).alias("k"))


#: The signals of a search: vectors of one model, the best of an entry's own and its shadow, of entries that are there and active.
_ACTIVE = re.sub(
    r"s2 AS \(.*?\)\),\nqt AS",
    """s2 AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, name) AS rank FROM (
  SELECT query_id, 'doc-' || owner AS name, max(list_cosine_similarity(v, vec)) AS cos FROM (
    SELECT CASE WHEN vec_id % 5 = 4 THEN vec_id - 1 ELSE vec_id END AS owner, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 11 <> 3) x
  JOIN documents ON doc_id = owner AND doc_id % 6 <> 0, {queries} JOIN {questions} q USING (query_id) WHERE trim(q.text) <> '' GROUP BY 1, 2)),
qt AS""",
    _SIGNALS,
    flags=re.DOTALL,
)
_FOUND = f"""WITH {_ACTIVE}, a AS (SELECT f.* FROM f JOIN documents d ON f.name = 'doc-' || d.doc_id WHERE d.doc_id % 6 <> 0)"""


@query(f"""{_FOUND} SELECT query_id, rank, name, round(score, 9) AS score, 'p' || substr(name, 5) AS projection_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM a) WHERE rank <= 8""")
def search_default(t):
    r = S.search(_memory(t), _queries(t), S.Options(model="new"))
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "name", F.round("score", 9).alias("score"), "projection_id")


#: A fused sub-query is searched to ten times the depth, and its signals to ten times that.
_DEEP = _FOUND.replace("rank <= 100", "rank <= CASE WHEN query_id IN (SELECT query_id FROM own JOIN n USING (grp) WHERE subs > 1) THEN 800 ELSE 100 END").replace(
    "WITH ", "WITH own AS (SELECT min(query_id) AS query_id, grp FROM (SELECT query_id, query_id // 200 AS grp, trim(text) AS text FROM {questions} WHERE trim(text) <> '') GROUP BY grp, text), n AS (SELECT grp, count(*) AS subs FROM own GROUP BY 1),\n", 1
)


@query(f"""{_DEEP}, o AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM a),
m AS (SELECT grp, name, CASE WHEN subs = 1 THEN 1.0 / min(rank) ELSE sum(1.0::DOUBLE / (60 + rank)) END AS place, CASE WHEN subs = 1 THEN NULL ELSE round(sum(1.0::DOUBLE / (60 + rank)), 9) END AS score FROM o JOIN own USING (query_id) JOIN n USING (grp) WHERE rank <= CASE WHEN subs = 1 THEN 8 ELSE 80 END GROUP BY grp, name, subs)
SELECT grp AS query_id, rank, name, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(place, 12) DESC, name) AS rank FROM m) WHERE rank <= 8""")
def search_multi(t):
    """Questions of a group as one question's sub-queries."""
    subs = _queries(t).select(F.expr("query_id div 200").alias("query_id"), F.col("query_id").alias("sub_id"), "text", "vec", "now")
    alone = S.distinct_texts(subs).groupBy("query_id").agg((F.count("*") == 1).alias("alone"))
    r = S.search_multi(_memory(t), subs, 8, S.Options(model="new")).join(alone, "query_id")
    return r.select("query_id", F.col("rank").cast("long").alias("rank"), "name", F.when(~F.col("alone"), F.round("score", 9)).alias("score"))


@query("""WITH q AS (SELECT query_id, lower(regexp_extract(text, '[A-Za-z]{5,}')) AS part FROM {questions}), f AS (SELECT DISTINCT query_id, list_position(list_transform(regexp_extract_all(text, '[A-Za-z0-9_''-]+|[\\x{4E00}-\\x{9FFF}]+'), lambda x: lower(x)), p) AS place, p FROM (SELECT query_id, text, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_''-]+|[\\x{4E00}-\\x{9FFF}]+'), lambda x: lower(x))) AS p FROM {questions}) WHERE length(p) >= 3),
a AS (SELECT 'doc-' || doc_id AS name, lower('aka ' || regexp_extract(text, '[A-Za-z]{6,}')) AS alias FROM documents), st AS (SELECT count(*) AS n, avg(greatest(length(alias) - 2, 0)) AS avgdl FROM a),
h AS (SELECT p, name, alias, CAST(greatest(length(alias) - 2, 0) AS DOUBLE) AS dl, CAST(len(list_filter(range(1, length(alias) - length(p) + 2), lambda i: substr(alias, CAST(i AS INTEGER), length(p)) = p)) AS DOUBLE) AS tf FROM (SELECT DISTINCT p FROM f) JOIN a ON contains(alias, p)),
d AS (SELECT p, count(*) AS df FROM h GROUP BY 1), sc AS (SELECT p, name, alias, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM h JOIN d USING (p), st),
r AS (SELECT query_id, place, name, row_number() OVER (PARTITION BY query_id, place ORDER BY round(score, 9) DESC, name, alias) AS nth FROM f JOIN sc USING (p)), m AS (SELECT query_id, name, min(place * 100000 + nth) AS o FROM r WHERE nth <= 100 GROUP BY 1, 2)
SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY o, name) AS rank FROM m""", name="alias_join")
def alias_join(t):
    return S.alias_ranks(_memory(t)["aliases"], t.questions).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH ev AS (SELECT 'doc-' || doc_id AS name, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS d FROM documents WHERE doc_id % 10 <> 0), q AS (SELECT user_id AS query_id, user_id % 2 = 0 AS before, DATE '2024-01-01' + CAST(user_id * 7 % 365 AS INTEGER) AS day FROM events GROUP BY 1),
m AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY abs(epoch_us(d) - epoch_us(CAST(day AS TIMESTAMP))), name) AS rank FROM q JOIN ev ON CASE WHEN before THEN d < day ELSE d > day END) SELECT query_id, name, rank FROM m WHERE rank <= 20""", name="asof_before_after")
def asof_before_after(t):
    u = F.col("user_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (u * 7 % 365).cast("int"))
    w = F.struct(F.when(u % 2 == 0, "before").otherwise("after").alias("intent"), day.alias("at"), F.lit("").alias("entity"))
    windows = t.events.select("user_id").distinct().select(u.alias("query_id"), w.alias("w"))
    return S.directional(_memory(t), windows, 20).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH q AS (SELECT doc_id AS query_id, lower(substr(text, 1, 12)) AS entity, doc_id % 200 = 0 AS before FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL AND trim(substr(text, 1, 12)) <> ''), e AS (SELECT 'doc-' || doc_id AS name, doc_id, lower('doc-' || doc_id || chr(10) || chr(10) || text) AS said, lower('aka ' || regexp_extract(text, '[A-Za-z]{6,}')) AS alias FROM documents WHERE doc_id % 10 <> 0)
SELECT query_id, TIMESTAMP '2024-01-01' + to_days(CAST(arg_max(doc_id, (doc_id, name)) % 365 AS INTEGER)) AS "at" FROM q JOIN e ON contains(said, entity) OR contains(alias, entity) GROUP BY 1""", name="temporal_anchor")
def temporal_anchor(t):
    d = t.documents.where("doc_id % 100 = 0 AND text IS NOT NULL").withColumn("entity", F.lower(F.substring("text", 1, 12))).where("trim(entity) <> ''")
    w = F.struct(F.when(F.col("doc_id") % 200 == 0, "before").otherwise("after").alias("intent"), F.lit(None).cast("date").alias("at"), "entity")
    return S.anchors(_memory(t), d.select(F.col("doc_id").alias("query_id"), w.alias("w")))


@query("""WITH e AS {doc_entities}, q AS (SELECT DISTINCT doc_id AS query_id, lower(text) AS t FROM documents WHERE doc_id % 100 = 0), c AS (SELECT DISTINCT query_id, entity FROM q JOIN (SELECT DISTINCT entity FROM e) x ON contains(' ' || regexp_replace(t, '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g') || ' ', ' ' || entity || ' '))
SELECT query_id, entry, count(*) AS matched FROM c JOIN (SELECT DISTINCT entry, entity FROM e) USING (entity) GROUP BY 1, 2""")
def whole_query_entities(t):
    from tidemark.operators.retrieval import whole_query_signal

    ascii_only = F.regexp_replace("text", r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+", " ")
    q = t.documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), ascii_only.alias("text"))
    return whole_query_signal(q, t.doc_entities)[1]


@query(f"""WITH {_SIGNALS}, h AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM f), ee AS (SELECT DISTINCT entry, entity FROM {{doc_entities}}), tk AS (SELECT DISTINCT query_id, entity FROM h JOIN ee ON entry = name WHERE rank <= 10)
SELECT query_id, name, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, name) AS rank FROM (SELECT query_id, entry AS name, count(*) AS shared FROM tk JOIN ee USING (entity) GROUP BY 1, 2)) WHERE rank <= 25""")
def search_neighbours(t):
    from tidemark.plans.retrieval_queries import _fused

    hits = _fused(t).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name")))
    return S.neighbours(hits, t.doc_entities).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_SIGNALS}, x AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM f), y AS (SELECT query_id, name, rank FROM s2 WHERE rank <= 100), uu AS (SELECT query_id, name, min(CASE WHEN side = 1 AND rank <= 5 THEN rank WHEN side = 2 THEN 1000 + rank ELSE 1000000 + rank END) AS place FROM (SELECT *, 1 AS side FROM x UNION ALL SELECT *, 2 FROM y WHERE (query_id, name) NOT IN (SELECT (query_id, name) FROM x)) GROUP BY 1, 2)
SELECT query_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM uu) WHERE rank <= 10""", name="retry_union")
def retry_union(t):
    from tidemark.plans.retrieval_queries import _fused, _signals

    signals = _signals(t)
    signals["vec"] = Work(t.spark, "retry").write(signals["vec"], "vec")  # read three times
    first = Work(t.spark, "retry").write(_fused(t, signals).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))), "first")
    return S.retry_union(first, signals["vec"], 10).withColumn("rank", F.col("rank").cast("long"))


# events: a JSON of each turn, with what is wrong in it by the turn's number
def _events(t):
    k = F.col("conv_id") + F.col("turn")
    fact = F.struct(F.when(k % 7 == 1, "").when(k % 7 == 2, F.repeat(F.lit("x"), 501)).otherwise(F.concat(F.lit("it was "), F.when(k % 2 == 0, "yesterday").otherwise("blue"))).alias("text"))
    relation = F.struct(F.when(k % 7 == 3, "odd").otherwise("causal").alias("relation_type"), F.lit("a").alias("subject"), F.when(k % 7 == 4, " ").otherwise("b").alias("object"), F.lit("because").alias("text"))
    e = F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.array(F.when(k % 7 == 5, "").otherwise(F.concat_ws(":", "conv_id", "turn"))).alias("source_ledger_ids"), F.col("role").alias("speaker"), F.array(fact).alias("fact_entries"), F.array(relation).alias("relation_entries"),
                           F.when(k % 3 == 0, "2024-05-06").when(k % 3 == 1, "May").alias("absolute_ts")))
    return t.conversations.select("conv_id", "turn", F.when(k % 7 == 6, F.lit("no json")).otherwise(F.concat(F.lit("Sure: "), e, F.lit(" done"))).alias("said"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 1 THEN 'fact text' WHEN 2 THEN 'fact text' WHEN 3 THEN 'relation_type' WHEN 4 THEN 'relation' WHEN 5 THEN 'source_ledger_ids' WHEN 6 THEN 'malformed' ELSE '' END AS strict, CASE (conv_id + turn) % 7 WHEN 1 THEN 'fact text' WHEN 2 THEN 'fact text' WHEN 4 THEN 'relation' WHEN 5 THEN 'source_ledger_ids' WHEN 6 THEN 'malformed' ELSE '' END AS lenient FROM conversations""")
def event_checks(t):
    strict, lenient = (E.problem(E.parsed(F.col("said"), x)) for x in (False, True))
    return _events(t).select("conv_id", "turn", F.coalesce(strict, F.lit("")).alias("strict"), F.coalesce(lenient, F.lit("")).alias("lenient"))


@query("""WITH x AS (SELECT conv_id, conv_id + turn AS k FROM conversations), y AS (SELECT conv_id, k % 3 < 2 AS anchored, k % 3 = 1 AS bad, k % 2 = 0 AS says, k % 7 IN (0, 3) AS legal FROM x WHERE k % 7 IN (0, 3))
SELECT conv_id, count(*) AS events, count(*) FILTER (anchored) AS anchored, count(*) FILTER (says) AS timely, count(*) FILTER (bad) AS bad_format, count(*) FILTER (legal) AS legal, round(count(*) FILTER (anchored) / CAST(count(*) AS DOUBLE), 4) AS rate, CASE WHEN count(*) FILTER (says) > 0 THEN round(count(*) FILTER (says AND anchored) / CAST(count(*) FILTER (says) AS DOUBLE), 4) ELSE 0 END AS timely_rate FROM y GROUP BY 1""")
def event_anchoring(t):
    return E.anchoring(E.extracted(_events(t), "said").where("event IS NOT NULL"), ["conv_id"])


@query("""WITH x AS (SELECT conv_id, turn, role, conv_id + turn AS k FROM conversations WHERE (conv_id + turn) % 7 IN (0, 3)), y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY conv_id || ':' || turn) AS n FROM x)
SELECT conv_id, md5(string_agg('[EVENT ' || n || '] (speaker: ' || role || CASE k % 3 WHEN 0 THEN ', 2024-05-06' WHEN 1 THEN ', May' ELSE '' END || ')' || chr(10) || '  FACT: it was ' || CASE WHEN k % 2 = 0 THEN 'yesterday' ELSE 'blue' END || chr(10) || CASE WHEN k % 7 = 3 THEN '' ELSE '  RELATION (causal): because' || chr(10) END, '' ORDER BY n)) AS text FROM y GROUP BY 1""")
def event_project(t):
    return E.rendered(E.extracted(_events(t), "said").where("event IS NOT NULL"), "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS x FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS x FROM benchmark),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(length(x) - 18, 1)), lambda i: substr(x, CAST(i AS INTEGER), 20)))) AS g FROM d WHERE length(x) >= 20), h AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(length(x) - 18, 1)), lambda i: substr(x, CAST(i AS INTEGER), 20)))) AS g FROM b WHERE length(x) >= 20)
SELECT doc_id, item_id, count(*) AS shared FROM g JOIN h USING (g) GROUP BY 1, 2""")
def contamination_20gram(t):
    return N.contaminated(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query(r"""WITH r AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'mit' WHEN 1 THEN 'gpl' WHEN 2 THEN NULL ELSE 'apache-2.0' END AS license, CASE doc_id % 4 WHEN 0 THEN 'test' ELSE 'train' END AS split, text AS query FROM documents)
SELECT id, 'missing license' AS problem FROM r WHERE license IS NULL UNION ALL SELECT id, 'license' FROM r WHERE license IS NULL OR license = 'gpl' UNION ALL SELECT id, 'split' FROM r WHERE split = 'test'
UNION ALL SELECT id, 'personal data' FROM r WHERE regexp_matches(query, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b([0-9]{3}-?){2}[0-9]{4}\b') UNION ALL SELECT id, 'namespace' FROM r WHERE regexp_matches(query, '(?i)\bnamespace\b')""")
def training_audit(t):
    k = F.col("doc_id")
    rows = t.documents.select(k.alias("id"), F.when(k % 5 == 0, "mit").when(k % 5 == 1, "gpl").when(k % 5 > 2, "apache-2.0").alias("license"), F.when(k % 4 == 0, "test").otherwise("train").alias("split"), F.col("text").alias("query"))
    return N.audit(rows, ("id", "query", "license", "split"))


@query(r"""WITH w AS (SELECT conv_id, turn, role, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations), q AS (SELECT conv_id AS query_id, w AS p, list_filter(w, lambda x: length(x) >= 3) AS asked FROM w WHERE turn = 0),
m AS (SELECT query_id, conv_id || ':' || turn AS doc_id, len(list_intersect(asked, list_filter(w, lambda x: length(x) >= 3))) AS shared, query_id % 2 = 0 AND turn % 3 <> 0 AND regexp_matches(text, '\b[0-9]{4}\b|(?i)\b(ago|since|until|after|before|recently)\b') AS timely FROM q JOIN w ON conv_id = query_id AND turn <> 0 WHERE NOT (len(p) > 0 AND len(w) > 0 AND len(list_intersect(w, p)) / CAST(len(w) + len(p) - len(list_intersect(w, p)) AS DOUBLE) > 0.7)),
x AS (SELECT query_id, doc_id, 'in-dialogue' AS kind FROM m UNION ALL SELECT query_id, doc_id, 'temporal-hard' FROM m WHERE timely AND shared >= 1)
SELECT query_id, doc_id, kind, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY sha256('s:' || kind || ':' || query_id || ':' || doc_id), doc_id) AS nth FROM x) WHERE nth <= 3""")
def hard_negatives(t):
    c = t.conversations
    name = F.concat_ws(":", "conv_id", "turn")
    day = F.when(F.col("turn") % 3 == 0, F.lit("2024-01-05").cast("date")).otherwise(F.lit("2024-03-05").cast("date"))
    pool = c.select(F.col("conv_id").alias("dialogue"), name.alias("doc_id"), "text", day.alias("date"))
    first = c.where("turn = 0")
    q = first.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("dialogue"), "text", F.lit("2024-01-01").cast("date").alias("date"), (F.col("conv_id") % 2 == 0).alias("temporal"))
    n = N.hard_negatives(pool, first.select(F.col("conv_id").alias("query_id"), name.alias("doc_id"), "text"), q, "s", 3, 30, 1)
    return n.withColumn("nth", F.col("nth").cast("long"))


@query("""WITH r AS (SELECT doc_id, lang, source, sha256('k11:' || doc_id) AS h FROM documents), s AS (SELECT greatest(1, 60 // count(*)) AS share FROM (SELECT DISTINCT lang, source FROM r)), x AS (SELECT doc_id, h, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) > share AS late FROM r, s) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY late, h, doc_id) AS n FROM x) WHERE n <= 60""")
def stratified_sample(t):
    return N.stratified(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 60, "k11").select("doc_id")


@query("""WITH c AS (SELECT DISTINCT query_id, 'doc-' || n AS name FROM (SELECT query_id, unnest(range(query_id, query_id + 20)) AS n FROM {questions} WHERE query_id < 1000000)), e AS {doc_entities}, tk AS (SELECT query_id, unnest(list_concat([lower(text)], regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM {questions}),
own AS (SELECT DISTINCT query_id, entity FROM c JOIN e ON entry = name), cue AS (SELECT DISTINCT query_id, entity FROM tk JOIN (SELECT DISTINCT entity FROM e) ON token = entity) SELECT DISTINCT query_id, token AS entity FROM tk JOIN own USING (query_id) WHERE token = own.entity UNION SELECT query_id, entity FROM cue""")
def demand_atoms(t):
    q = t.questions
    c = q.where("query_id < 1000000").select("query_id", F.explode(F.sequence(F.col("query_id"), F.col("query_id") + 19)).alias("n")).select("query_id", F.concat(F.lit("doc-"), "n").alias("name"))
    return X.demand_atoms(q, c, t.doc_entities)


@query("""WITH h AS (SELECT session AS query_id, id AS projection_id, row_number() OVER (PARTITION BY session ORDER BY first_turn, id) AS rank FROM {projections}), j AS (SELECT query_id, rank, h.projection_id, l.evidence_id, source_order, content, state FROM h JOIN {lineage} l ON l.projection_id = h.projection_id LEFT JOIN {evidence} e ON e.id = l.evidence_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, projection_id, source_order, evidence_id) AS nth, evidence_id, md5(CASE WHEN source_order = 2 THEN substr(content, 3, 10) ELSE content END) AS text, CASE WHEN source_order = 2 THEN 'EXTRACT' ELSE 'KEEP' END AS kind, coalesce(state = 'active' AND (source_order <> 2 OR length(content) >= 12), false) AS found FROM j""")
def expanded_sources(t):
    return _expanded(t).select("query_id", F.col("nth").cast("long").alias("nth"), "evidence_id", F.md5(F.col("text").cast("binary")).alias("text"), "kind", "found")


def _expanded(t):
    hits = t.projections.select(F.col("session").alias("query_id"), F.col("id").alias("projection_id"), F.row_number().over(Window.partitionBy("session").orderBy("first_turn", "id")).alias("rank"))
    part = F.col("source_order") == 2
    return X.expanded(hits, t.lineage.withColumn("start", F.when(part, 2)).withColumn("end", F.when(part, 12)), t.evidence)


@query("""WITH j AS (SELECT p.session AS query_id, l.projection_id, l.evidence_id, source_order, content FROM {projections} p JOIN {lineage} l ON l.projection_id = p.id LEFT JOIN {evidence} e ON e.id = l.evidence_id), w AS (SELECT query_id, projection_id, max(source_order) < 2 AS whole FROM j GROUP BY 1, 2)
SELECT query_id, projection_id, 'KEEP' AS kind, string_agg(evidence_id, ',' ORDER BY source_order, evidence_id) AS sources, md5('text of ' || projection_id) AS text FROM j JOIN w USING (query_id, projection_id) WHERE whole GROUP BY 1, 2 UNION ALL
SELECT query_id, projection_id, CASE WHEN source_order = 2 THEN 'EXTRACT' ELSE 'KEEP' END, evidence_id, md5(CASE WHEN source_order = 2 THEN substr(content, 3, 10) ELSE content END) FROM j JOIN w USING (query_id, projection_id) WHERE NOT whole""")
def verbatim_fold(t):
    texts = t.projections.select(F.col("id").alias("projection_id"), F.concat(F.lit("text of "), "id").alias("content"))
    f = X.folded(_expanded(t), texts)
    return f.select("query_id", "projection_id", "kind", F.array_join("sources", ",").alias("sources"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH q AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, (conv_id + turn) % 5 AS category, turn % 4 = 3 AS adversarial FROM conversations WHERE (conv_id * 3 + turn) % 7 <> 2), o AS (SELECT * FROM q WHERE turn % 11 <> 5),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, adversarial ORDER BY turn, id) AS nth FROM o) SELECT id, category, adversarial FROM n WHERE CASE WHEN adversarial THEN nth <= 1 ELSE nth <= 3 END""")
def chosen_questions(t):
    """Of each conversation the first three answerable questions and the first unanswerable one, of those in a list of ids."""
    c = t.conversations.withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    q = c.where("(conv_id * 3 + turn) % 7 <> 2").select("conv_id", "turn", "id", "text", ((F.col("conv_id") + F.col("turn")) % 5).alias("category"), (F.col("turn") % 4 == 3).alias("adversarial"))
    return X.chosen_questions(q, "conv_id", "turn", only=c.where("turn % 11 <> 5"), most=3, adversarial=1).select("id", "category", "adversarial")


@query("""WITH q AS (SELECT doc_id AS query_id, lang AS category FROM documents WHERE doc_id % 100 = 0), o AS (SELECT lang AS category, CAST(count(*) % 20 + 5 AS BIGINT) AS top, CAST(count(*) % 5 AS BIGINT) AS quota FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT query_id, q.category, coalesce(top, 30) AS top, coalesce(quota, 12) AS quota FROM q LEFT JOIN o ON q.category = o.category""")
def category_budgets(t):
    """Every language but one has a depth and a quota of its own."""
    over = t.documents.where("lang <> 'en'").groupBy(F.col("lang").alias("category")).agg((F.count("*") % 20 + 5).alias("top"), (F.count("*") % 5).alias("quota"))
    q = t.documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"))
    return X.budgets(q, over, 30, 12).select("query_id", "category", F.col("top").cast("long").alias("top"), F.col("quota").cast("long").alias("quota"))


@query("""WITH e AS (SELECT DISTINCT entry, entity FROM {doc_entities}), s AS (SELECT entity, 1.0 / count(*) AS score FROM e GROUP BY 1), b AS (SELECT * FROM s ORDER BY score DESC, entity LIMIT 200)
SELECT entry, round(sum(score), 9) AS score FROM b JOIN e USING (entity) GROUP BY 1""")
def entry_scores(t):
    """Entries of the 200 rarest entities, by the sum of their scores."""
    from tidemark.operators.graph import entry_scores as run

    e = t.doc_entities.select("entry", "entity").distinct()
    scores = e.groupBy("entity").agg((1.0 / F.count("*")).alias("score"))
    return run(scores, e).select("entry", F.round("score", 9).alias("score"))


@query("""SELECT ns, name, place FROM (SELECT ns, name, row_number() OVER (PARTITION BY ns ORDER BY hit_count DESC, updated_at DESC, name) AS place FROM {entries} WHERE NOT pinned) WHERE place <= 40""")
def manifest_order(t):
    """A manifest in the order of the score that it has unless another is given."""
    from tidemark.operators.retrieval import top
    from tidemark.plugins import manifest_score

    rows = t.entries.where("NOT pinned").withColumn("score", manifest_score(F.col("hit_count"), F.col("updated_at")))
    return top(rows, ["ns"], [F.desc("score"), "name"], 40, "place").select("ns", "name", F.col("place").cast("long").alias("place"))
