"""Evaluation statistics over two runs made of the labels, and costs over events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import evaluation as S
from tidemark.plans.registry import query

_T = ", ".join(f"({n}, {v})" for n, v in S.T_95.items())


@query("SELECT coalesce(category, 'overall') AS category, count(*) AS n, round(avg(CAST(control AS INT)), 6) AS control, round(avg(CAST(treatment AS INT)), 6) AS treatment FROM {runs} GROUP BY ROLLUP (category)")
def accuracy_rollup(t):
    r = t.runs.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("control").cast("int")), 6).alias("control"), F.round(F.avg(F.col("treatment").cast("int")), 6).alias("treatment"))
    return r.withColumn("category", F.coalesce("category", F.lit("overall")))


@query("SELECT user_id, count(*) AS votes, 2 * count(*) FILTER (value > 50) >= count(*) AS majority FROM (SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2) GROUP BY 1")
def majority_vote(t):
    once = t.events.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))
    return once.groupBy("user_id").agg(F.count("*").alias("votes"), (2 * F.count_if(F.col("value") > 50) >= F.count("*")).alias("majority"))


@query("SELECT category, count(*) AS n, count(*) FILTER (control AND treatment) AS both, count(*) FILTER (control AND NOT treatment) AS left_only, count(*) FILTER (NOT control AND treatment) AS right_only, count(*) FILTER (NOT control AND NOT treatment) AS neither FROM {runs} GROUP BY 1")
def mcnemar_counts(t):
    return S.discordant(t.runs, ["category"])


@query("""SELECT category, n, round(100 * m, 6) AS delta_pp, round(100 * (m - coalesce(1.96 * sd / sqrt(n), 0)), 6) AS low_pp, round(100 * (m + coalesce(1.96 * sd / sqrt(n), 0)), 6) AS high_pp
FROM (SELECT category, count(*) AS n, avg(CAST(treatment AS INT) - CAST(control AS INT)) AS m, stddev_samp(CAST(treatment AS INT) - CAST(control AS INT)) AS sd FROM {runs} GROUP BY 1)""")
def paired_ci(t):
    r = S.paired_interval(t.runs, ["category"])
    return r.select("category", "n", *[F.round(c, 6).alias(c) for c in ("delta_pp", "low_pp", "high_pp")])


@query("""SELECT category, k, n, round(greatest(c - s, 0), 6) AS low, round(least(c + s, 1), 6) AS high FROM (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS s
FROM (SELECT category, count(*) FILTER (control) AS k, count(*) AS n, count(*) FILTER (control) / CAST(count(*) AS DOUBLE) AS p FROM {runs} GROUP BY 1))""")
def wilson(t):
    g = t.runs.groupBy("category").agg(F.count_if("control").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("category", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""SELECT category, quantile_disc(tokens, 0.95) AS p95, quantile_disc(tokens, 0.5) AS p50, round(avg(tokens), 6) AS mean FROM {runs} GROUP BY 1""")
def percentile_nearest(t):
    return t.runs.groupBy("category").agg(S.percentile_ceil("tokens", 0.95).cast("long").alias("p95"), S.percentile_ceil("tokens", 0.5).cast("long").alias("p50"), F.round(F.avg("tokens"), 6).alias("mean"))


@query("""SELECT category, tokens AS value FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tokens) AS nth, count(*) OVER (PARTITION BY category) AS n FROM {runs}) WHERE nth = greatest(1, least(n, floor(n * 0.9 + 0.5)))""")
def percentile_half_up(t):
    return S.percentile_ranked(t.runs.select("category", "tokens"), ["category"], "tokens", 0.9, "half_up")


@query(f"""SELECT category, n, round(m, 6) AS mean, round(m - tc * sd / sqrt(n), 6) AS low, round(m + tc * sd / sqrt(n), 6) AS high FROM (SELECT *, coalesce((SELECT v FROM (VALUES {_T}) tt(df, v) WHERE tt.df = g.n - 1), CASE WHEN n - 1 < 30 THEN 2.042 WHEN n - 1 < 40 THEN 2.021 WHEN n - 1 < 60 THEN 2.0 WHEN n - 1 < 120 THEN 1.98 ELSE 1.962 END) AS tc
FROM (SELECT category, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd FROM {{runs}} GROUP BY 1) g)""")
def mean_t_interval(t):
    g = t.runs.groupBy("category").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    margin = S.t_point(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return g.select("category", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - margin, 6).alias("low"), F.round(F.col("m") + margin, 6).alias("high"))


@query("""SELECT event_type AS role, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, CASE event_type WHEN 'error' THEN NULL ELSE round(sum(k) * 2.5 / 1e6, 9) END AS usd, event_type = 'error' AS unpriced FROM (SELECT event_type, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1""")
def cost_by_role(t):
    k = F.get_json_object("props", "$.k").cast("long")
    g = t.events.groupBy(F.col("event_type").alias("role")).agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"))
    return g.withColumn("usd", F.when(F.col("role") != "error", F.round(F.col("tokens") * 2.5 / 1e6, 9))).withColumn("unpriced", F.col("role") == "error")


@query("""WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2) SELECT x.user_id, x.event_type AS one, y.event_type AS two, x.a <= y.b AND y.a <= x.b AS overlap FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type < y.event_type""")
def interval_overlap(t):
    s = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    x, y = s.select("user_id", F.col("event_type").alias("one"), F.col("a").alias("xa"), F.col("b").alias("xb")), s.select("user_id", F.col("event_type").alias("two"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    return x.join(y, "user_id").where("one < two").select("user_id", "one", "two", ((F.col("xa") <= F.col("yb")) & (F.col("ya") <= F.col("xb"))).alias("overlap"))


@query("""SELECT category, question_id, rank FROM (SELECT category, question_id, row_number() OVER (PARTITION BY category, control <> treatment ORDER BY sha256('seed' || chr(1) || question_id), question_id) AS rank, control <> treatment AS disc FROM {runs}) WHERE disc OR rank <= 10""")
def stratified_hash_sample(t):
    digest = F.sha2(F.concat(F.lit("seed\x01"), F.col("question_id").cast("string")), 256)
    rows = t.runs.withColumn("disc", F.col("control") != F.col("treatment"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("category", "disc").orderBy(digest, "question_id")).cast("long"))
    return ranked.where(F.col("disc") | (F.col("rank") <= 10)).select("category", "question_id", "rank")


@query("""SELECT norm, votes, rank FROM (SELECT norm, votes, row_number() OVER (ORDER BY votes DESC, norm) AS rank FROM (SELECT regexp_replace(lower(event_type || ' ' || CAST(floor(value / 20) AS BIGINT)), '[^a-z0-9]', '', 'g') AS norm, count(*) AS votes FROM events GROUP BY 1))""")
def answer_vote(t):
    norm = F.regexp_replace(F.lower(F.concat_ws(" ", "event_type", F.floor(F.col("value") / 20))), "[^a-z0-9]", "")
    g = t.events.groupBy(norm.alias("norm")).agg(F.count("*").alias("votes"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("votes"), "norm")).cast("long"))


@query("""SELECT coalesce(a.question_id, b.question_id) AS question_id, a.question_id IS NULL AS added, b.question_id IS NULL AS removed FROM (SELECT question_id, sha256(category || control) AS d FROM {runs} WHERE control) a FULL JOIN (SELECT question_id, sha256(category || treatment) AS d FROM {runs} WHERE treatment) b ON a.question_id = b.question_id AND a.d = b.d WHERE a.question_id IS NULL OR b.question_id IS NULL""")
def rebuild_compare(t):
    r = t.runs
    a = r.where("control").select("question_id", F.sha2(F.concat("category", F.col("control").cast("string")), 256).alias("d"))
    b = r.where("treatment").select(F.col("question_id").alias("other"), F.sha2(F.concat("category", F.col("treatment").cast("string")), 256).alias("e"))
    both = a.join(b, (a["question_id"] == b["other"]) & (a["d"] == b["e"]), "full_outer").where("question_id IS NULL OR other IS NULL")
    return both.select(F.coalesce("question_id", "other").alias("question_id"), F.col("question_id").isNull().alias("added"), F.col("other").isNull().alias("removed"))
