"""What retrieval and answers miss, over rankings of vectors, sessions, runs and answers made of ids, against SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions.intent import resolution_mode
from tidemark.operators import diagnostics as D, evaluation as S, retrieval as R
from tidemark.plans.registry import query
from tidemark.work import Work

# rankings of all other vectors for every hundredth one, by cosine and by inner product; gold: the vectors of the same owner
_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_RANKED = f"""qq AS (SELECT vec_id AS query_id, {_V} AS q FROM embeddings WHERE vec_id % 100 = 0), pp AS (SELECT query_id, vec_id AS name, list_cosine_similarity({_V}, q) AS cos, list_dot_product({_V}, q) AS dot FROM embeddings, qq WHERE vec_id <> query_id),
res AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, name) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, name) AS rank2 FROM pp),
gold AS (SELECT query_id, vec_id AS name FROM embeddings, qq WHERE vec_id <> query_id AND vec_id % 125 = query_id % 125)"""


def _results(t, by: str = "cos"):
    """The 300 best of each query: blocks pass on no more than those and the query's own vector."""
    e = t.embeddings.select(F.col("vec_id").alias("name"), F.col("embedding").alias("v"))
    pairs = R.blocks_cosine(e, t.queries.select("query_id", F.col("vec").alias("v")), 301, dot=by == "dot", by_name=True).where("name <> query_id")
    return R.top(pairs, ["query_id"], [F.desc(F.round("cos", 9)), "name"], 300).select("query_id", "name", "rank")


def _gold(t):
    q = t.queries.select("query_id")
    return t.embeddings.select(F.col("vec_id").alias("name"), (F.col("vec_id") % 125).alias("k")).join(q.withColumn("k", F.col("query_id") % 125), "k").where("name <> query_id").select("query_id", "name")


@query(f"""WITH {_RANKED}, f AS (SELECT query_id, count(*) AS gold, min(rank) FILTER (rank <= 300) AS r FROM gold JOIN res USING (query_id, name) GROUP BY 1)
SELECT query_id, gold, coalesce(CASE WHEN r <= 30 THEN r END, 0) AS rank_top, coalesce(r, 0) AS rank_pool, coalesce(least(r - 1, 5), 0) AS outranked FROM f""")
def gold_ranks(t):
    g = D.gold_ranks(_results(t), _gold(t))
    return g.select("query_id", "gold", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("rank_top", "rank_pool")], "outranked")


@query(f"""WITH {_RANKED} SELECT query_id, count(*) AS gold, count(*) FILTER (rank <= 30) AS found, round(count(*) FILTER (rank <= 30) / CAST(count(*) AS DOUBLE), 6) AS recall FROM gold JOIN res USING (query_id, name) GROUP BY 1""")
def evidence_recall(t):
    return D.recalls(_results(t), _gold(t)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_RANKED} SELECT query_id, count(*) FILTER (rank <= 5) AS r5, count(*) FILTER (rank BETWEEN 6 AND 10) AS r10, count(*) FILTER (rank BETWEEN 11 AND 15) AS r15, count(*) FILTER (rank BETWEEN 16 AND 20) AS r20, count(*) FILTER (rank BETWEEN 21 AND 30) AS r30, count(*) FILTER (rank > 30) AS rest FROM gold JOIN res USING (query_id, name) WHERE rank <= 300 GROUP BY 1""", name="rank_bands")
def rank_bands(t):
    j = _results(t).join(_gold(t), ["query_id", "name"])
    r = F.col("rank")
    return j.groupBy("query_id").agg(*[F.count_if(r.between(a, b)).alias(n) for a, b, n in ((1, 5, "r5"), (6, 10, "r10"), (11, 15, "r15"), (16, 20, "r20"), (21, 30, "r30"))], F.count_if(r > 30).alias("rest"))


@query(f"""WITH {_RANKED}, f AS (SELECT query_id, min(rank) FILTER (rank <= 300) AS r FROM gold JOIN res USING (query_id, name) GROUP BY 1), c AS (SELECT query_id, r, label, query_id % 300 = 0 AS lost, CASE WHEN query_id % 200 <> 0 THEN query_id % 400 = 100 END AS correct FROM f JOIN embeddings ON vec_id = query_id)
SELECT quadrant, count(*) AS n FROM (SELECT CASE WHEN lost THEN 'gold_unresolved' WHEN correct IS NULL THEN 'retrieval_only' WHEN r <= 30 THEN CASE WHEN correct THEN 'ok' ELSE 'answer_side' END WHEN r IS NOT NULL THEN 'ranking' ELSE 'extraction_side' END AS quadrant FROM c) GROUP BY 1""")
def attribution_quadrants(t):
    g, q = D.gold_ranks(_results(t), _gold(t)), F.col("query_id")
    kind = D.quadrant(q % 300 != 0, F.col("rank_top"), F.col("rank_pool"), F.when(q % 200 != 0, q % 400 == 100))
    return g.groupBy(kind.alias("quadrant")).agg(F.count("*").alias("n"))


@query(f"""WITH {_RANKED}, f AS (SELECT query_id, least(coalesce(min(rank), 31), 31) AS a, least(coalesce(min(rank2), 31), 31) AS b, count(*) FILTER (rank <= 30) / CAST(count(*) AS DOUBLE) AS ra, count(*) FILTER (rank2 <= 30) / CAST(count(*) AS DOUBLE) AS rb FROM gold JOIN res USING (query_id, name) GROUP BY 1)
SELECT count(*) AS questions, round(avg(a), 6) AS single_rank, round(avg(b), 6) AS multi_rank, round(avg(b - a), 6) AS delta, count(*) FILTER (a > 30 AND b <= 30) AS entered, count(*) FILTER (a <= 30 AND b > 30) AS "left", round(avg(ra), 6) AS single_recall, round(avg(rb), 6) AS multi_recall FROM f""")
def recall_diagnostic(t):
    parts = []
    for by, name in (("cos", "single"), ("dot", "multi")):
        r = Work(t.spark, "results").write(_results(t, by), by)
        parts.append(D.gold_ranks(r, _gold(t)).select("query_id", F.col("rank_pool").alias(name)).join(D.recalls(r, _gold(t)).select("query_id", F.col("recall").alias(f"{name}_recall")), "query_id"))
    s = D.recall_summary(parts[0].join(parts[1], "query_id"))
    return s.select(*[c if c in ("questions", "entered", "left") else F.round(c, 6).alias(c) for c in s.columns])


# coverage of a session's user turns by active projections, as ids
_COVER = """cv AS (SELECT a.session, count(DISTINCT a.id) AS gold, count(DISTINCT CASE WHEN p.state = 'active' THEN a.id END) AS covered, count(DISTINCT CASE WHEN p.state = 'active' AND a.state = 'active' THEN a.id END) AS live FROM {evidence} a LEFT JOIN {lineage} l ON l.evidence_id = a.id LEFT JOIN {projections} p ON p.id = l.projection_id WHERE a.speaker = 'user' GROUP BY 1)"""


def _coverage(t):
    gold = t.evidence.where("speaker = 'user'").select("session", F.col("id").alias("evidence_id"), F.col("state").alias("own"))
    j = gold.join(t.lineage, "evidence_id", "left").join(t.projections.select(F.col("id").alias("projection_id"), "state"), "projection_id", "left")
    held = F.col("state") == "active"
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("evidence_id"))))
    g = j.groupBy("session").agg(ids(F.lit(True)).alias("gold"), ids(held).alias("covered"), ids(held & (F.col("own") == "active")).alias("live"))
    return g.withColumn("candidates", D.coverage(F.col("covered"), F.col("gold"))).withColumn("bundle", D.coverage(F.col("live"), F.col("gold")))


@query(f"WITH {_COVER} SELECT session, round(covered / CAST(gold AS DOUBLE), 6) AS share FROM cv")
def source_coverage(t):
    return _coverage(t).select("session", F.round("candidates", 6).alias("share"))


@query(f"""WITH {_COVER} SELECT session, CASE WHEN x < 0.25 THEN '[0.00,0.25)' WHEN x < 0.5 THEN '[0.25,0.50)' WHEN x < 0.75 THEN '[0.50,0.75)' ELSE '[0.75,1.00]' END AS stratum FROM (SELECT session, covered / CAST(gold AS DOUBLE) AS x FROM cv)""", name="coverage_strata")
def coverage_strata(t):
    return _coverage(t).select("session", D.stratum(F.col("candidates")).alias("stratum"))


@query(f"""WITH {_COVER}, x AS (SELECT session, session % 9 <> 0 AS resolved, covered = gold AS cand, live = gold AS bun, session % 4 <> 1 AS correct FROM cv)
SELECT session, CASE WHEN NOT resolved THEN 'gold_unresolved' WHEN NOT cand THEN 'candidate' WHEN NOT bun THEN 'compiler' WHEN NOT correct THEN 'answerer' ELSE 'success' END AS miss, CASE WHEN correct THEN 'success' WHEN NOT resolved THEN 'gold_unresolved' WHEN NOT cand THEN 'candidate' WHEN NOT bun THEN 'compiler' ELSE 'answerer' END AS notebook FROM x""", name="miss_classes")
def miss_classes(t):
    s, c, b = F.col("session"), F.col("candidates"), F.col("bundle")
    return _coverage(t).select("session", D.miss_class(s % 9 != 0, c, b, s % 4 != 1).alias("miss"), D.notebook_class(s % 9 != 0, c >= 1, b >= 1, s % 4 != 1).alias("notebook"))


@query("""WITH v AS (SELECT user_id, max(n) AS most FROM (SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1, 2) GROUP BY 1) SELECT user_id, user_id % 3 < 2 AS applicable, most, user_id % 3 < 2 AND most > 1 AS resolution_miss, user_id % 3 < 2 AND most <= 1 AS candidate_miss FROM v""")
def temporal_oracle(t):
    k = F.col("user_id") % 3
    mode = resolution_mode(F.when(k == 0, "has it changed").when(k == 1, "what holds as of 2024").otherwise("who"))
    v = t.events.groupBy("user_id", "event_type").agg(F.count_distinct(F.to_date("ts")).alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("versions"))
    return v.select("user_id", D.temporal_verdict(mode, F.col("versions")).alias("x")).select("user_id", "x.*")


@query("""SELECT category, round(avg(CAST(control AS INT)), 6) AS accuracy, round(avg(tokens), 6) AS tokens, quantile_disc(tokens, 0.95) AS tokens_p95, round(avg(score), 6) AS latency, round(quantile_disc(score, 0.95), 6) AS latency_p95 FROM {runs} GROUP BY 1""")
def formal_metrics(t):
    m = D.formal_metrics(t.runs.select("category", F.col("control").alias("correct"), "tokens", F.col("score").alias("latency")), ["category"])
    return m.select("category", *[F.round(c, 6).alias(c) for c in ("accuracy", "tokens", "latency", "latency_p95")], F.col("tokens_p95").cast("long").alias("tokens_p95"))


@query("SELECT user_id, count(*) AS votes, CASE WHEN count(*) % 2 = 0 THEN 'even' WHEN 2 * count(*) FILTER (value > 50) > count(*) THEN 'yes' ELSE 'no' END AS majority FROM events GROUP BY 1")
def strict_majority(t):
    m = D.strict_majority(t.events.select("user_id", (F.col("value") > 50).alias("correct")), ["user_id"])
    return m.select("user_id", "votes", F.when(F.col("majority").isNull(), "even").when(F.col("majority"), "yes").otherwise("no").alias("majority"))


@query("""WITH c AS (SELECT o_orderkey AS question, p_brand AS entity, p_type AS slot FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), d AS (SELECT o_orderkey AS question, 'Brand#' || (o_orderkey % 5 + 1) || (o_orderkey % 4 + 1) AS entity, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ECONOMY' ELSE 'STANDARD' END AS slot FROM orders)
SELECT d.question, coalesce(max(CASE WHEN c.question IS NULL THEN 0 WHEN d.slot <> '' AND c.slot = d.slot THEN 2 ELSE 1 END), 0) AS level FROM d LEFT JOIN c ON c.question = d.question AND c.entity = d.entity GROUP BY 1""")
def claim_levels(t):
    claims = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_orderkey").alias("question"), F.col("p_brand").alias("entity"), F.col("p_type").alias("slot"))
    k = F.col("o_orderkey")
    demands = t.orders.select(k.alias("question"), F.concat(F.lit("Brand#"), k % 5 + 1, k % 4 + 1).alias("entity"), F.when(k % 3 == 0, "").when(k % 3 == 1, "ECONOMY").otherwise("STANDARD").alias("slot"))
    return D.claim_match(claims, demands).select("question", F.col("level").cast("int").alias("level"))


# the sweep with a first point above all scores, and with rows that are always flagged
def _swept(always: str) -> str:
    return f"""sc AS (SELECT score, NOT control AS pos, {always} AS always FROM {{runs}}), b AS (SELECT count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n, count(*) FILTER (pos AND always) AS bp, count(*) FILTER (NOT pos AND always) AS bn FROM sc),
 pt AS (SELECT score AS threshold, sum(a) OVER w + bp AS tp, sum(c) OVER w + bn AS fp, p, n FROM (SELECT score, count(*) FILTER (pos AND NOT always) AS a, count(*) FILTER (NOT pos AND NOT always) AS c FROM sc GROUP BY 1), b WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 9.0, bp, bn, p, n FROM b),
 roc AS (SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / CAST(p AS DOUBLE), 6) AS recall, round(fp / CAST(n AS DOUBLE), 6) AS false_rate, CAST(round(tp - fp * 0.676) AS BIGINT) AS net FROM pt)"""


def _points(p):
    return p.select(F.round(F.least("threshold", F.lit(9.0)), 6).alias("threshold"), "tp", "fp", F.round("recall", 6).alias("recall"), F.round("false_rate", 6).alias("false_rate"), "net")


def _roc(t):
    return S.roc(t.runs.withColumn("positive", ~F.col("control")), "score", "positive")


@query(f"WITH {_swept('false')} SELECT * FROM roc", name="roc_points")
def roc_points(t):
    return _points(_roc(t))


@query(f"WITH {_swept('false')} SELECT round(sum((false_rate - px) * (recall + py) / 2), 5) AS auc FROM (SELECT false_rate, recall, lag(false_rate) OVER (ORDER BY threshold DESC) AS px, lag(recall) OVER (ORDER BY threshold DESC) AS py FROM (SELECT threshold, tp / CAST(p AS DOUBLE) AS recall, fp / CAST(n AS DOUBLE) AS false_rate FROM pt))", name="roc_auc")
def roc_auc(t):
    return S.auc(_roc(t)).select(F.round("auc", 5).alias("auc"))


@query(f"WITH {_swept('tokens % 3 = 0')} SELECT * FROM roc")
def roc_combined(t):
    rows = t.runs.select((~F.col("control")).alias("adversarial"), (1 - F.col("score")).alias("confidence"), (F.col("tokens") % 3 != 0).alias("matched"))
    p = D.combined_roc(rows.withColumn("confidence", F.col("confidence")))
    return _points(p)


@query(f"""WITH {_swept('false')}, m AS (SELECT *, recall >= 0.5 AND false_rate <= 0.6 AND net >= -1000 AS meets, greatest(0, 0.5 - recall) + greatest(0, false_rate - 0.6) + greatest(0, (-1000 - net) / 1.0) AS gap FROM roc)
SELECT threshold, net, meets FROM m ORDER BY NOT meets, CASE WHEN meets THEN -net ELSE gap END, threshold DESC LIMIT 1""")
def roc_best(t):
    return D.best_point(_points(_roc(t)), 0.5, 0.6, -1000).select("threshold", "net", "meets")


_P = "least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)))))"
_EXACT = f"(SELECT category, b, c, CASE WHEN b = c THEN 1.0 ELSE {_P} END AS p FROM (SELECT category || k AS category, count(*) FILTER (control AND NOT treatment) AS b, count(*) FILTER (NOT control AND treatment) AS c FROM (SELECT *, question_id % 5 AS k FROM {{runs}}) GROUP BY 1))"


def _exact(t):
    d = S.discordant(t.runs.withColumn("category", F.concat("category", (F.col("question_id") % 5).cast("string"))), ["category"])
    return d.select("category", "left_only", "right_only", F.round(S.exact_p("left_only", "right_only"), 9).alias("p"))


@query(f"SELECT category, b AS left_only, c AS right_only, round(p, 9) AS p FROM {_EXACT}", name="mcnemar_exact")
def mcnemar_exact(t):
    return _exact(t)


@query(f"""SELECT category, round(p, 9) AS p, round(0.05 / (m - i + 1), 9) AS threshold, min(CAST(p <= 0.05 / (m - i + 1) AS INT)) OVER (ORDER BY p, category) = 1 AS rejected FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, category) AS i FROM (SELECT category, round(p, 9) AS p FROM {_EXACT} WHERE c < b))""", name="holm_gate")
def holm_gate(t):
    """Of the categories that lose."""
    return S.holm_gate(_exact(t).where("right_only < left_only").select("category", "p"), "p", "category").select("category", "p", F.round("threshold", 9).alias("threshold"), "rejected")


@query(f"""SELECT category, p, round(max(least(1.0, p * (m - i + 1))) OVER (ORDER BY p, category), 9) AS adjusted FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, category) AS i FROM (SELECT category, round(p, 9) AS p FROM {_EXACT}))""", name="holm_adjusted")
def holm_adjusted(t):
    return S.holm_adjusted(_exact(t).select("category", "p"), "p", "category").withColumn("adjusted", F.round("adjusted", 9))


@query(f"""SELECT category, b, c, round(100.0 * (c - b) / n, 6) AS delta_pp, round(p, 6) AS p FROM (SELECT category, b, c, n, CASE WHEN b = c THEN 1.0 ELSE {_P} END AS p FROM (SELECT category, count(*) AS n, count(*) FILTER (control AND NOT treatment) AS b, count(*) FILTER (NOT control AND treatment) AS c FROM {{runs}} GROUP BY 1))""")
def paired_categories(t):
    d = S.discordant(t.runs, ["category"])
    return d.select("category", F.col("left_only").alias("b"), F.col("right_only").alias("c"), F.round(100.0 * (F.col("right_only") - F.col("left_only")) / F.col("n"), 6).alias("delta_pp"), F.round(S.exact_p("left_only", "right_only"), 6).alias("p"))


# three answers for each question, by arithmetic on the id
_ANSWERS = """ans AS (SELECT doc_id AS question, lang AS category, 'C' || k AS slot, 'Answer ' || CASE WHEN k = 2 THEN '' ELSE '-' END || (doc_id * k % 4) AS answer, doc_id * k % 4 = 1 AS correct FROM documents, (VALUES (1), (2), (3)) x(k))"""


def _answers(t):
    rows = t.documents.select(F.col("doc_id").alias("question"), F.col("lang").alias("category"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k"))
    n = F.col("question") * F.col("k") % 4
    return rows.select("question", "category", F.concat(F.lit("C"), "k").alias("slot"), F.concat(F.lit("Answer "), F.when(F.col("k") == 2, "").otherwise("-"), n).alias("answer"), (n == 1).alias("correct"))


@query(f"""WITH {_ANSWERS}, g AS (SELECT question, regexp_replace(lower(answer), '[^a-z0-9]', '', 'g') AS norm, string_agg(slot, ',' ORDER BY slot) AS slots, arg_min(slot, (answer, slot)) AS first_slot, count(DISTINCT answer) AS texts FROM ans GROUP BY 1, 2) SELECT * FROM g""", name="source_of_groups")
def answer_groups(t):
    g = D.answer_groups(_answers(t))
    return g.select("question", "norm", F.array_join("slots", ",").alias("slots"), "first_slot", F.size("answers").cast("long").alias("texts"))


_JUDGED = f"""{_ANSWERS}, g AS (SELECT question, regexp_replace(lower(answer), '[^a-z0-9]', '', 'g') AS norm, count(*) AS k, arg_min(slot, (answer, slot)) AS first_slot FROM ans GROUP BY 1, 2), ctl AS (SELECT question, first_slot FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY k DESC, norm) AS nth FROM g) WHERE nth = 1),
j AS (SELECT a.question, a.category, a.majority, a.oracle, a.mixed, c.correct AS control, s.correct AS selected, s.norm AS snorm, a.good FROM (SELECT question, any_value(category) AS category, 2 * count(*) FILTER (correct) > count(*) AS majority, bool_or(correct) AS oracle, bool_or(correct) AND NOT bool_and(correct) AS mixed, list(regexp_replace(lower(answer), '[^a-z0-9]', '', 'g')) FILTER (correct) AS good FROM ans GROUP BY 1) a
 JOIN ctl USING (question) JOIN ans c ON c.question = a.question AND c.slot = first_slot JOIN (SELECT *, regexp_replace(lower(answer), '[^a-z0-9]', '', 'g') AS norm FROM ans) s ON s.question = a.question AND s.slot = 'C' || (a.question % 3 + 1))"""


def _decisions(t):
    return t.documents.select(F.col("doc_id").alias("question"), F.concat(F.lit("C"), F.col("doc_id") % 3 + 1).alias("slot"))


@query(f"WITH {_JUDGED} SELECT question, majority, oracle, control, selected, mixed FROM j")
def adjudication(t):
    return D.adjudicated(_answers(t), _decisions(t))


@query(f"""WITH {_JUDGED}, m AS (SELECT category, CASE WHEN list_contains(good, snorm) THEN 'semantic_equivalence' WHEN question % 2 = 0 THEN 'evidence_insufficient' ELSE 'factually_wrong' END AS mode FROM j WHERE NOT selected AND oracle), n AS (SELECT category, mode, count(*) AS n FROM m GROUP BY 1, 2)
SELECT category, mode, n, arg_min(mode, (-n, mode)) OVER (PARTITION BY category) AS dominant FROM n""")
def failure_modes(t):
    a = _answers(t).withColumn("norm", F.regexp_replace(F.lower("answer"), "[^a-z0-9]", ""))
    good = a.where("correct").groupBy("question").agg(F.collect_list("norm").alias("good"))
    wrong = a.join(_decisions(t), ["question", "slot"]).where(~F.col("correct")).join(good, "question")
    cited = F.when(F.col("question") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))
    return D.mode_table(wrong.select("category", D.failure_mode(F.col("norm"), F.col("good"), cited).alias("mode")))


@query("""WITH a AS (SELECT doc_id AS question, v, 'g' || g AS grp, CASE WHEN g = doc_id % 3 THEN CASE WHEN (doc_id + v) % 4 < 3 THEN 'no' ELSE 'yes' END WHEN (doc_id * 3 + g + (doc_id % 5) * v) % 3 = 0 THEN 'yes' ELSE 'no' END AS support, CASE WHEN g = doc_id % 3 AND doc_id % 7 <> 0 THEN 'yes' ELSE 'no' END AS contra FROM documents, range(0, 2) x(v), range(0, 3) y(g)),
w AS (SELECT question, v, bool_or(grp = 'g' || question % 3 AND contra = 'yes' AND support <> 'yes') AS refuted, list(DISTINCT grp) FILTER (grp <> 'g' || question % 3 AND support = 'yes' AND contra <> 'yes') AS others FROM a GROUP BY 1, 2), z AS (SELECT question, CASE WHEN refuted AND len(others) = 1 THEN others[1] END AS t FROM w)
SELECT question, CASE WHEN count(t) = 2 AND min(t) = max(t) THEN min(t) ELSE 'g' || question % 3 END AS final, count(t) = 2 AND min(t) = max(t) AS switched FROM z GROUP BY question""")
def two_views(t):
    rows = t.documents.select(F.col("doc_id").alias("question"), F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("g"))
    d, v, g = F.col("question"), F.col("v"), F.col("g")
    own = g == d % 3
    support = F.when(own, F.when((d + v) % 4 < 3, "no").otherwise("yes")).when((d * 3 + g + (d % 5) * v) % 3 == 0, "yes").otherwise("no")
    a = rows.select("question", v.alias("view"), F.concat(F.lit("g"), g).alias("grp"), support.alias("support"), F.when(own & (d % 7 != 0), "yes").otherwise("no").alias("contradiction"))
    return D.two_views(a, t.documents.select(F.col("doc_id").alias("question"), F.concat(F.lit("g"), F.col("doc_id") % 3).alias("grp")))


@query("""SELECT (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, count(*) FILTER (doc_id % 4 = 0) AS invalid, count(*) FILTER (doc_id % 4 <> 0 AND quality = 1) AS correct, 'cap,source' AS reasons FROM labels""")
def gold_oracle_summary(t):
    r = t.labels.select(F.col("doc_id").alias("question"), (F.col("doc_id") % 4 != 0).alias("valid"), F.when(F.col("doc_id") % 8 == 0, "cap").otherwise("source").alias("reason"), (F.col("quality") == 1).alias("correct"))
    return D.oracle_summary(t.documents.select(F.col("doc_id").alias("question")), r)


@query("""SELECT session, count(*) AS decisions, count(*) FILTER (ordinal % 3 = 1) AS suppressed, count(*) FILTER (ordinal % 3 = 1 AND n > 1) AS suspected FROM (SELECT e.session, e.id, ordinal, (SELECT count(*) FROM {lineage} l WHERE l.evidence_id = e.id) AS n FROM {evidence} e) GROUP BY 1""")
def suppression_counts(t):
    n = t.lineage.groupBy(F.col("evidence_id").alias("id")).agg(F.count("*").alias("sources"))
    rows = t.evidence.join(n, "id", "left").select("session", (F.col("ordinal") % 3 == 1).alias("suppressed"), F.coalesce("sources", F.lit(0)).alias("sources"))
    return D.suppression_counts(rows, ["session"])


@query("""WITH x AS (SELECT DISTINCT user_id AS question, event_type || ' ' || (event_id % 4) AS raw, event_type || (event_id % 4) AS id, min(event_id) OVER (PARTITION BY user_id, event_type, event_id % 4) AS place FROM events), y AS (SELECT question, id, place, CASE WHEN ends_with(id, '3') THEN NULL ELSE 'e-' || substr(id, 1, 3) END AS ev FROM x),
r AS (SELECT question, ev, min(place) AS place FROM y WHERE ev IS NOT NULL GROUP BY 1, 2)
SELECT question, coalesce((SELECT string_agg(ev, ',' ORDER BY place) FROM r WHERE r.question = q.question), '') AS resolved, coalesce((SELECT string_agg(id, ',' ORDER BY place) FROM y WHERE y.question = q.question AND ev IS NULL), '') AS unresolved FROM (SELECT DISTINCT question FROM x) q""")
def id_resolution(t):
    e = t.events.withColumn("id", F.concat("event_type", F.col("event_id") % 4))
    wanted = e.groupBy(F.col("user_id").alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "id"))), lambda x: F.concat(F.lit(" "), x["id"])).alias("ids"))
    known = e.select(F.col("id").alias("dataset_id")).distinct().withColumn("evidence_id", F.when(~F.col("dataset_id").endswith("3"), F.concat(F.lit("e-"), F.substring("dataset_id", 1, 3))).otherwise(""))
    return D.resolved_ids(wanted, known).select("question", F.array_join("resolved", ",").alias("resolved"), F.array_join("unresolved", ",").alias("unresolved"))


@query(f"""SELECT vec_id % 125 AS owner, count(*) AS repeats, round(max(d), 6) AS drift FROM (SELECT b.vec_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM (SELECT vec_id, {_V} AS v FROM embeddings WHERE vec_id < 125) a JOIN (SELECT vec_id, {_V} AS v FROM embeddings WHERE vec_id >= 125) b ON b.vec_id % 125 = a.vec_id) GROUP BY 1""", name="embedding_drift")
def embedding_drift(t):
    """Repeated embeddings of one text: largest distance from the first."""
    from tidemark.functions.vectors import l2

    e = t.embeddings.select((F.col("vec_id") % 125).alias("owner"), "vec_id", "embedding")
    first, later = e.where("vec_id < 125").select("owner", F.col("embedding").alias("a")), e.where("vec_id >= 125")
    return later.join(first, "owner").groupBy("owner").agg(F.count("*").alias("repeats"), F.round(F.max(l2(F.col("embedding"), F.col("a"))), 6).alias("drift"))
