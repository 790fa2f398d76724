"""What retrieval and answers miss: gold ranks, recalls, quadrants, miss classes, abstention curves and adjudication.

Results are (query_id, rank, name); gold is (query_id, name). Ranks start at 1; an absent rank is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TOP = 30  # rank beyond which a result counts as missed
# Floors of the four layers of the temporal diagnosis, and what a layer below its floor is called.
FLOORS = (("parse_coverage", 0.5, "解析器"), ("date_coverage", 0.5, "抽取侧"), ("buried_ratio", 0.2, "非召回瓶颈"), ("lift_ratio", 0.2, "天花板不足"))


def gold_ranks(results: DataFrame, gold: DataFrame, top: int = TOP, leaders: int = 5) -> DataFrame:
    """For each query with gold: (query_id, gold, rank_top, rank_pool, outranked), the first gold rank up to top and in the whole pool.

    outranked counts the results before it that are no gold, up to leaders of them; 0 where gold is nowhere.
    """
    marked = results.join(gold.withColumn("hit", F.lit(True)), ["query_id", "name"], "left")
    first = marked.where("hit").groupBy("query_id").agg(F.min("rank").alias("rank_pool"))
    counts = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    out = counts.join(first, "query_id", "left")
    before = F.coalesce(F.least(F.col("rank_pool") - 1, F.lit(leaders)), F.lit(0))
    return out.select("query_id", "gold", F.when(F.col("rank_pool") <= top, F.col("rank_pool")).alias("rank_top"), "rank_pool", before.cast("long").alias("outranked"))


def recalls(results: DataFrame, gold: DataFrame, top: int = TOP) -> DataFrame:
    """Share of the gold of each query among its first results: (query_id, gold, found, recall)."""
    kept = results.where(F.col("rank") <= top).select("query_id", "name").distinct().withColumn("hit", F.lit(1))
    g = gold.join(kept, ["query_id", "name"], "left").groupBy("query_id").agg(F.count("*").alias("gold"), F.count("hit").alias("found"))
    return g.withColumn("recall", F.col("found") / F.col("gold"))


def coverage(found: Column, wanted: Column) -> Column:
    """Matched share of distinct wanted ids; 1 where nothing is wanted."""
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, found)) / F.size(F.array_distinct(wanted)))


def stratum(share: Column, bounds: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Column:
    """The label of the half-open bin of a share; the last bin is closed."""
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(bounds, bounds[1:]))):
        last = b == bounds[-1]
        out = F.when((share >= a) & ((share <= b) if last else (share < b)), f"[{a:.2f},{b:.2f}{']' if last else ')'}").otherwise(out)
    return out


def quadrant(resolved: Column, rank_top: Column, rank_pool: Column, correct: Column) -> Column:
    """Which side loses a question: ok, answer_side, ranking, extraction_side, gold_unresolved; retrieval_only where no answer was judged."""
    shown = F.when(correct, "ok").otherwise("answer_side")
    return F.when(~resolved, "gold_unresolved").when(correct.isNull(), "retrieval_only").when(rank_top.isNotNull(), shown).when(rank_pool.isNotNull(), "ranking").otherwise("extraction_side")


def miss_class(resolved: Column, candidates: Column, bundle: Column, correct: Column) -> Column:
    """The first layer that falls short of full coverage."""
    return F.when(~resolved, "gold_unresolved").when(candidates < 1, "candidate").when(bundle < 1, "compiler").when(~correct, "answerer").otherwise("success")


def notebook_class(resolved: Column, candidate: Column, bundle: Column, correct: Column) -> Column:
    """As miss_class, a right answer being a success whatever the layers say."""
    return F.when(correct, "success").when(~resolved, "gold_unresolved").when(~candidate, "candidate").when(~bundle, "compiler").otherwise("answerer")


def temporal_verdict(mode: Column, versions: Column) -> Column:
    """Whether versions in the pool could resolve a question: struct (applicable, most, resolution_miss, candidate_miss)."""
    most, applies = F.coalesce(F.array_max(versions), F.lit(0)), mode != "degraded"
    return F.struct(applies.alias("applicable"), most.alias("most"), (applies & (most > 1)).alias("resolution_miss"), (applies & (most <= 1)).alias("candidate_miss"))


def recall_summary(questions: DataFrame, top: int = TOP) -> DataFrame:
    """Means over questions (single, multi: first gold ranks by two searches, single_recall, multi_recall), a missing rank counting as top + 1."""
    r = lambda c: F.coalesce(F.when(F.col(c) <= top, F.col(c)), F.lit(top + 1))
    inside = lambda c: F.coalesce(F.col(c) <= top, F.lit(False))
    return questions.agg(F.count("*").alias("questions"), F.avg(r("single")).alias("single_rank"), F.avg(r("multi")).alias("multi_rank"), F.avg(r("multi") - r("single")).alias("delta"), F.count_if(~inside("single") & inside("multi")).alias("entered"), F.count_if(inside("single") & ~inside("multi")).alias("left"),
                         F.avg("single_recall").alias("single_recall"), F.avg("multi_recall").alias("multi_recall"))


def temporal_summary(questions: DataFrame) -> DataFrame:
    """Ratios of the four layers over questions (parsed, gold_facts, dated_facts, resolved, buried, buried_facts, lifted_facts, rank_pool), and a verdict."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = questions.agg(F.count("*").alias("questions"), F.count_if("parsed").alias("p"), F.sum("gold_facts").alias("g"), F.sum("dated_facts").alias("d"), F.count_if("resolved").alias("r"), F.count_if(F.col("resolved") & F.col("buried")).alias("b"), F.sum("buried_facts").alias("bf"), F.sum("lifted_facts").alias("lf"))
    # ranks are counted by value: a row for each place of a pool, whatever the number of questions
    ranks = questions.where(F.col("resolved") & F.col("rank_pool").isNotNull()).groupBy("rank_pool").agg(F.count("*").alias("k"))
    ranks = ranks.withColumn("upto", F.sum("k").over(Window.orderBy("rank_pool"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * p + 0.5))), F.col("rank_pool")))
    s = s.crossJoin(F.broadcast(ranks.agg(at(0.5).alias("p50"), at(0.9).alias("p90"))))  # one row each
    nearest = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = s.select("questions", ratio(F.col("p"), F.col("questions")).alias("parse_coverage"), ratio(F.col("d"), F.col("g")).alias("date_coverage"), ratio(F.col("b"), F.col("r")).alias("buried_ratio"), ratio(F.col("lf"), F.col("bf")).alias("lift_ratio"), nearest("p50"), nearest("p90"))
    cause = F.lit(None).cast("string")
    for name, floor, reason in reversed(FLOORS):
        cause = F.when(F.col(name) < floor, reason).otherwise(cause)
    return out.withColumn("cause", cause).withColumn("verdict", F.when(F.col("cause").isNull(), "GO").otherwise("NO-GO"))


def formal_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, and mean and nearest-rank p95 of tokens and latency."""
    p95 = lambda c: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")
    return rows.groupBy(*by).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("tokens").alias("tokens"), p95("tokens").alias("tokens_p95"), F.avg("latency").alias("latency"), p95("latency").alias("latency_p95"))


def strict_majority(rows: DataFrame, by: list[str]) -> DataFrame:
    """Majority of an odd number of votes (correct); null where it is even."""
    return rows.groupBy(*by).agg(F.count("*").alias("votes"), F.when(F.count("*") % 2 == 1, 2 * F.count_if("correct") > F.count("*")).alias("majority"))


def claim_match(claims: DataFrame, demands: DataFrame) -> DataFrame:
    """Best match of a question's claims (question, entity, slot) with its demands: 2 by entity and slot, 1 by entity, 0 none."""
    d = demands.select("question", "entity", F.col("slot").alias("wanted")).where("entity <> ''")
    met = claims.join(d, ["question", "entity"]).groupBy("question").agg(F.max(F.when((F.col("wanted") != "") & (F.col("slot") == F.col("wanted")), 2).otherwise(1)).alias("level"))
    return demands.select("question").distinct().join(met, "question", "left").select("question", F.coalesce("level", F.lit(0)).alias("level"))


def combined_roc(rows: DataFrame) -> DataFrame:
    """A sweep over 1 - confidence in which questions without a claim match are always flagged: (threshold, tp, fp, recall, false_rate, net).

    rows: (adversarial, confidence, matched). The first threshold, above all scores, is infinite.
    """
    from tidemark.operators.evaluation import sweep

    scored = rows.select((1 - F.col("confidence")).alias("score"), F.col("adversarial").alias("positive"), (~F.col("matched")).alias("always"))
    return sweep(scored)


def best_point(points: DataFrame, recall: float, false_rate: float, net: int) -> DataFrame:
    """Of points that meet a gate the one of most net, of equal ones the highest threshold; without any, the nearest to the gate."""
    gap = F.greatest(F.lit(0.0), recall - F.col("recall")) + F.greatest(F.lit(0.0), F.col("false_rate") - false_rate) + F.greatest(F.lit(0.0), (net - F.col("net")) / F.lit(float(net if net > 0 else 1)))
    meets = (F.col("recall") >= recall) & (F.col("false_rate") <= false_rate) & (F.col("net") >= net)
    rows = points.withColumn("meets", meets).withColumn("order", F.struct((~meets).alias("a"), F.when(meets, -F.col("net").cast("double")).otherwise(gap).alias("b"), (-F.col("threshold")).alias("c")))
    return rows.agg(F.min_by(F.struct("threshold", "recall", "false_rate", "net", "meets"), "order").alias("x")).select("x.*")


def answer_groups(answers: DataFrame) -> DataFrame:
    """Answers (question, slot, answer) of one normal form: (question, norm, slots, first_slot, answers), the first by answer and slot."""
    norm = F.regexp_replace(F.lower("answer"), "[^a-z0-9]", "")
    return answers.withColumn("norm", norm).groupBy("question", "norm").agg(F.array_sort(F.collect_list("slot")).alias("slots"), F.min(F.struct("answer", "slot"))["slot"].alias("first_slot"), F.array_sort(F.collect_set(F.sha2("answer", 256))).alias("answers"))


def adjudicated(answers: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of each question what three answers (question, slot, answer, correct) and a decision (question, slot) make: majority, oracle, control, selected, mixed.

    The control is the first slot of the largest group of equal answers, ties by the normal form.
    """
    groups = answer_groups(answers)
    order = Window.partitionBy("question").orderBy(F.desc(F.size("slots")), "norm")
    control = groups.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("question", F.col("first_slot").alias("control_slot"))
    votes = answers.groupBy("question").agg((2 * F.count_if("correct") > F.count("*")).alias("majority"), F.bool_or("correct").alias("oracle"), (F.bool_or("correct") & ~F.bool_and("correct")).alias("mixed"))
    of = lambda rows, slot, name: rows.join(answers.select("question", F.col("slot").alias(slot), F.col("correct").alias(name)), ["question", slot])
    out = votes.join(of(control, "control_slot", "control"), "question").join(of(decisions.withColumnRenamed("slot", "chosen"), "chosen", "selected"), "question")
    return out.select("question", "majority", "oracle", "control", "selected", "mixed")


def failure_mode(selected_norm: Column, correct_norms: Column, cited: Column) -> Column:
    """Why a wrong choice is wrong, though a right answer was among the candidates."""
    return F.when(F.array_contains(correct_norms, selected_norm), "semantic_equivalence").when(F.size(cited) == 0, "evidence_insufficient").otherwise("factually_wrong")


def mode_table(rows: DataFrame) -> DataFrame:
    """Counts of failure modes (category, mode) by category, and which is most frequent; equal ones by name."""
    counts = rows.groupBy("category", "mode").agg(F.count("*").alias("n"))
    best = counts.groupBy("category").agg(F.min_by("mode", F.struct(-F.col("n"), F.col("mode"))).alias("dominant"))
    return counts.join(best, "category")


def two_views(assessments: DataFrame, current: DataFrame) -> DataFrame:
    """Whether two views (question, view, grp, support, contradiction) agree to leave the current group (question, grp) for one other.

    Returns (question, final, switched): both must refute the current one, and name one and the same alternative.
    """
    a = assessments.join(current.select("question", F.col("grp").alias("now")), "question")
    own = F.col("grp") == F.col("now")
    refuted = F.bool_or(own & (F.col("contradiction") == "yes") & (F.col("support") != "yes"))
    other = F.collect_set(F.when(~own & (F.col("support") == "yes") & (F.col("contradiction") != "yes"), F.col("grp")))
    views = a.groupBy("question", "now", "view").agg(refuted.alias("refuted"), other.alias("others"))
    views = views.withColumn("to", F.when(F.col("refuted") & (F.size("others") == 1), F.col("others")[0]))
    both = views.groupBy("question", "now").agg(F.count("to").alias("k"), F.count("*").alias("views"), F.min("to").alias("lo"), F.max("to").alias("hi"))
    switch = (F.col("views") == 2) & (F.col("k") == 2) & (F.col("lo") == F.col("hi"))
    return both.select("question", F.when(switch, F.col("lo")).otherwise(F.col("now")).alias("final"), F.coalesce(switch, F.lit(False)).alias("switched"))


def oracle_summary(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Whether every expected question (question) has a valid record (question, valid, reason, correct): counts and the reasons of invalid ones."""
    j = expected.select("question").distinct().join(records, "question", "left")
    return j.agg(F.count("*").alias("expected"), F.count_if(F.col("valid").isNull()).alias("missing"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & F.col("correct")).alias("correct"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("valid"), F.col("reason")))), ",").alias("reasons"))


def suppression_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Decisions, suppressed ones, and suspects among these: those of candidates with more than one source."""
    return rows.groupBy(*by).agg(F.count("*").alias("decisions"), F.count_if("suppressed").alias("suppressed"), F.count_if(F.col("suppressed") & (F.col("sources") > 1)).alias("suspected"))


def resolved_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Data set ids of each question (question, ids) as evidence ids by (dataset_id, evidence_id): (question, resolved, unresolved), in order, each once."""
    rows = wanted.select("question", F.posexplode("ids").alias("place", "raw")).withColumn("dataset_id", F.trim("raw")).where("dataset_id <> ''").groupBy("question", "dataset_id").agg(F.min("place").alias("place"))
    j = rows.join(known.where("evidence_id <> ''"), "dataset_id", "left")
    first = j.groupBy("question", "evidence_id", F.when(F.col("evidence_id").isNull(), F.col("dataset_id")).alias("lost")).agg(F.min("place").alias("place"))
    listed = lambda c, ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("place", c)))), lambda x: x[c])
    return first.groupBy("question").agg(listed("evidence_id", F.col("evidence_id").isNotNull()).alias("resolved"), listed("lost", F.col("lost").isNotNull()).alias("unresolved"))
