"""Re-weights, votes, audits, orders and maintenance over all of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import dates
from tidemark.operators import graph as G, retrieval as R
from tidemark.plans.registry import query
from tidemark.plans.retrieval_queries import _SIGNALS, _fused


@query(f"""WITH {_SIGNALS}, d AS (SELECT 'doc-' || doc_id AS name, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) AS made FROM documents),
w AS (SELECT f.query_id, f.name, score * CASE WHEN made < TIMESTAMP '2024-06-01' THEN exp(-(epoch_us(TIMESTAMP '2024-06-01') - epoch_us(made)) / 1e6 / 2592000.0) WHEN made > TIMESTAMP '2024-09-01' THEN exp(-(epoch_us(made) - epoch_us(TIMESTAMP '2024-09-01')) / 1e6 / 2592000.0) ELSE 1.0 END AS score FROM f JOIN d USING (name))
SELECT query_id, name, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, name) AS rank FROM w) WHERE rank <= 10""")
def temporal_reweight(t):
    at = t.entries.select("name", F.col("created_at").alias("at"))
    low, high = F.lit("2024-06-01").cast("timestamp"), F.lit("2024-09-01").cast("timestamp")
    hits = _fused(t).join(at, "name").withColumn("score", F.col("score") * dates.decay(F.col("at"), F.col("at"), low, high))
    return R.top(hits, ["query_id"], [F.desc(F.round("score", 12)), "name"], 10).select("query_id", "name", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT query_id, least(greatest((list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), vec) + 1) / 2, 0), 1) AS s FROM embeddings, {queries} q)
SELECT query_id, round((max(s) + avg(s)) / 2, 6) AS blended, round(max(s), 6) AS top1 FROM c GROUP BY 1""")
def confidence_blend(t):
    rows = t.embeddings.select(F.col("vec_id").alias("name"), F.col("embedding").alias("v"))
    shares = R.cosine_shares(rows, t.queries.select("query_id", F.col("vec").alias("v")))
    return shares.select("query_id", F.round((F.col("most") + F.col("mean")) / 2, 6).alias("blended"), F.round("most", 6).alias("top1"))


@query("""SELECT category, count(*) FILTER (NOT control AND treatment) AS false_negative, count(*) FILTER (control AND NOT treatment) AS false_positive, round(avg(CAST(control AS INT)), 6) AS raw, round(avg(CAST(treatment AS INT)), 6) AS corrected, round(avg(CAST(control = treatment AS INT)), 6) AS agreement FROM {runs} GROUP BY 1""")
def judge_noise(t):
    c, r = F.col("control"), F.col("treatment")
    mean = lambda x, n: F.round(F.avg(x.cast("int")), 6).alias(n)
    return t.runs.groupBy("category").agg(F.count_if(~c & r).alias("false_negative"), F.count_if(c & ~r).alias("false_positive"), mean(c, "raw"), mean(r, "corrected"), mean(c == r, "agreement"))


@query("""SELECT category, round(avg(CAST(score IS NOT NULL AS INT)), 6) AS scored, round(avg(CAST(tokens <= 2400 AS INT)), 6) AS within_cap, round(avg(CAST(tokens BETWEEN 100 AND 9000 AS INT)), 6) AS legal, count(*) FILTER (tokens < 100) AS bad FROM {runs} GROUP BY 1""")
def validity_rates(t):
    n = F.col("tokens")
    mean = lambda x, k: F.round(F.avg(x.cast("int")), 6).alias(k)
    return t.runs.groupBy("category").agg(mean(F.col("score").isNotNull(), "scored"), mean(n <= 2400, "within_cap"), mean(n.between(100, 9000), "legal"), F.count_if(n < 100).alias("bad"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT label AS centre, arg_min(v, vec_id) AS c FROM e GROUP BY 1)
SELECT id, centre, round(sim, 6) AS sim FROM (SELECT vec_id AS id, centre, round(list_cosine_similarity(v, c), 9) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, centre DESC) AS rank FROM e, c WHERE list_cosine_similarity(v, c) >= 0.2) WHERE rank = 1""")
def cluster_overlay(t):
    e = t.embeddings
    centres = e.groupBy(F.col("label").alias("centre")).agg(F.min_by("embedding", "vec_id").alias("c"))
    return G.overlay(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), centres.withColumnRenamed("c", "v"), 0.2).select("id", "centre", F.round("sim", 6).alias("sim"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT label AS centre, arg_min(v, vec_id) AS c, label % 4 AS members FROM e GROUP BY 1),
b AS (SELECT vec_id AS id, centre, members, round(list_cosine_similarity(v, c), 9) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, centre DESC) AS rank FROM e, c)
SELECT id, centre, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY id % 17, id) AS nth FROM b WHERE rank = 1 AND sim >= 0.2) WHERE nth <= 12 - members""")
def cluster_overlay_bounded(t):
    """As cluster_overlay, a cluster having twelve members at most, some of which it has already."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 17).alias("position"), "label")
    centres = e.groupBy(F.col("label").alias("centre")).agg(F.min_by("v", "id").alias("v"), (F.first("label") % 4).alias("members"))
    return G.overlay(e, centres, 0.2, 12).select("id", "centre", F.round("sim", 6).alias("sim"))


@query("""SELECT user_id, event_id, version, latest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS latest FROM events)""")
def version_order(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count("*").over(Window.partitionBy("user_id"))
    return t.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("version"), (F.row_number().over(w) == n).alias("latest"))


@query("""SELECT question_id, place FROM (SELECT question_id, row_number() OVER (PARTITION BY category ORDER BY sha256('blind:' || question_id), question_id) AS place FROM {runs})""")
def blinded_order(t):
    digest = F.sha2(F.concat(F.lit("blind:"), F.col("question_id").cast("string")), 256)
    return t.runs.select("question_id", F.row_number().over(Window.partitionBy("category").orderBy(digest, "question_id")).cast("long").alias("place"))


@query("""SELECT user_id, event_type, first_id, row_number() OVER (PARTITION BY user_id ORDER BY first_id) - 1 AS place FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2)""")
def canonical_drops(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return g.withColumn("place", (F.row_number().over(Window.partitionBy("user_id").orderBy("first_id")) - 1).cast("long"))


@query("""SELECT conv_id, 'legacy-' || conv_id || ':' || turn AS evidence_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, sha256(text) AS digest FROM conversations""")
def ledger_backfill(t):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select("conv_id", F.concat(F.lit("legacy-"), F.concat_ws(":", "conv_id", "turn")).alias("evidence_id"), place.cast("long").alias("ordinal"), F.sha2("text", 256).alias("digest"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) = coalesce(b.n, 0) AS equal, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b ON a.k = b.k""")
def multiset_equality(t):
    c = t.orders.where("o_orderstatus IN ('F', 'O')").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return c.select("k", (F.col("a") == F.col("b")).alias("equal"), (F.col("a") - F.col("b")).alias("surplus"))


@query("""SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'user') * 3 + count(*) FILTER (role <> 'user') AS planned FROM conversations GROUP BY 1""")
def session_now(t):
    user = F.count_if(F.col("role") == "user")
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), (user * 3 + F.count("*") - user).alias("planned"))
