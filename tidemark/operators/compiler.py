"""Evidence compilation: candidates and their sources, checked, become one bundle for each question within a token cap.

Tables: questions (query_id, query), candidates (query_id, id, kind, rank, score, text, text_digest, source_ids), sources
(id, content, digest, occurred_at, state). Spans are code points, ends exclusive. Where all sources of a question fit
as they are they are kept whole; else their sentences are admitted in order of need while they fit, each that doesn't
being skipped. A token is a word of the rendered text unless another count is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import needs
from tidemark.functions.text import negated, sentence_rows
from tidemark.operators.packing import admit

KINDS = ("chunk", "raw_turn", "semantic_episode", "atomic_fact")
ACTIONS = ("KEEP", "EXTRACT", "DROP", "MERGE", "FETCH_SOURCE")
FRAME = 5  # words of an item's opening and closing marks


def word_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def same_digest(digest: Column, text: Column) -> Column:
    return F.coalesce(F.lower(digest) == F.sha2(text, 256), F.lit(False))


def candidate_problems(candidates: DataFrame, most: int) -> DataFrame:
    """What is wrong with candidates: (query_id, id, problem), a row for each problem; none for a sound set."""
    order = Window.partitionBy("query_id").orderBy("place")
    rows = candidates.withColumn("last", F.lag("rank", 1, 0).over(order)).withColumn("same", F.count("*").over(Window.partitionBy("query_id", "id"))).withColumn("size", F.count("*").over(Window.partitionBy("query_id")))
    ids = F.col("source_ids")
    checks = {
        "kind": ~F.col("kind").isin(*KINDS), "id": F.col("id") == "", "repeated": F.col("same") > 1, "rank": (F.col("rank") <= 0) | (F.col("rank") <= F.col("last")), "score": F.isnan("score") | (F.abs("score") == float("inf")),
        "text": F.col("text") == "", "digest": ~same_digest(F.col("text_digest"), F.col("text")), "sources": (F.size(ids) == 0) | F.array_contains(ids, "") | (F.array_sort(F.array_distinct(ids)) != ids), "too many": F.col("size") > most,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in checks.items()]))
    return rows.select("query_id", "id", F.explode(found).alias("problem"))


def resolved(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Each source that candidates name: (query_id, source_id, candidate_ids, rank, content, occurred_at, found), found telling whether it is active and unchanged."""
    named = candidates.select("query_id", "rank", F.col("id").alias("candidate"), F.explode("source_ids").alias("source_id"))
    named = named.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("candidate")).alias("candidate_ids"))
    s = sources.select(F.col("id").alias("source_id"), "content", "digest", "occurred_at", "state")
    good = (F.col("state") == "active") & (F.col("content") != "") & same_digest(F.col("digest"), F.col("content"))
    return named.join(s, "source_id", "left").withColumn("found", F.coalesce(good, F.lit(False))).drop("digest", "state")


def action_problems(actions: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Proposed actions (query_id, nth, kind, candidate_id, source_id, start, end, digest, reason) that are not allowed: (query_id, nth, problem)."""
    c = candidates.select("query_id", F.col("id").alias("candidate_id"), F.col("source_ids").alias("own"), F.col("text").alias("own_text"))
    wanted = F.coalesce("source_id", F.when(F.col("kind") == "KEEP", F.try_element_at("own", F.lit(1))))
    s = resolved(candidates, sources).select("query_id", F.col("source_id").alias("of"), "content", "found")
    a = actions.join(c, ["query_id", "candidate_id"], "left").withColumn("of", wanted).join(s, ["query_id", "of"], "left")
    none = lambda *xs: F.greatest(*[F.col(x).isNotNull().cast("int") for x in xs], F.lit(0)) == 0
    found, named = F.coalesce(F.col("found"), F.lit(False)), F.col("candidate_id").isNotNull()
    cut = F.substr("content", F.col("start") + 1, F.col("end") - F.col("start"))
    inside = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("content")) & same_digest(F.col("digest"), cut), F.lit(False))
    keep = (named != F.col("source_id").isNotNull()) & none("start", "end", "reason") & found & (~named | ((F.size("own") == 1) & (F.col("own_text") == F.col("content"))))
    extract = none("reason") & found & inside & (~named | F.coalesce(F.array_contains("own", F.col("of")), F.lit(False)))
    drop = named & F.col("own").isNotNull() & none("source_id", "start", "end") & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    fetch = ~named & none("start", "end", "reason") & found
    legal = F.when(F.col("kind") == "KEEP", keep).when(F.col("kind") == "EXTRACT", extract).when(F.col("kind") == "DROP", drop).when(F.col("kind") == "FETCH_SOURCE", fetch).when(F.col("kind") == "MERGE", extract).otherwise(False)
    bad = ~F.coalesce(legal, F.lit(False))
    return a.where(bad).select("query_id", "nth", F.when(~F.col("kind").isin(*ACTIONS), "unknown action").when(~found & ~F.col("kind").isin("DROP"), "source").otherwise("shape").alias("problem"))


def items(questions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole sources and sentences of them as items, each with its place in the order of need.

    rows: as resolved gives them, sound ones alone. Returns (raw, extracts), both (query_id, kind, source_id, start, end, text,
    candidate_ids, rank, coverage, lexical, nth).
    """
    q = questions.select("query_id", needs.need(F.col("query")).alias("need"))
    full = rows.join(q, "query_id")
    timely = ((F.size("need.times") > 0) & (F.col("occurred_at").isNotNull() | needs.has_time(F.col("content")))).cast("int")
    whole = full.select("query_id", F.lit("KEEP").alias("kind"), "source_id", F.lit(0).alias("start"), F.length("content").alias("end"), F.col("content").alias("text"), "candidate_ids", "rank",
                        (needs.coverage(F.col("need"), F.col("content")) + timely).alias("coverage"), needs.lexical_overlap(F.col("need"), F.col("content")).alias("lexical"))
    raw = whole.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("lexical"), "rank", "source_id")))
    # each source's sentences once, whichever questions ask for it
    sentences = sentence_rows(rows.select("source_id", "content").distinct(), "source_id", "content")
    cut = full.join(sentences, "source_id")
    scored = cut.select("query_id", F.lit("EXTRACT").alias("kind"), "source_id", "start", "end", F.col("sentence").alias("text"), "candidate_ids", "rank", needs.coverage(F.col("need"), F.col("sentence")).alias("coverage"), needs.lexical_overlap(F.col("need"), F.col("sentence")).alias("lexical"))
    own = Window.partitionBy("query_id", "source_id").orderBy(F.desc("coverage"), F.desc("lexical"), "start")
    kept = scored.withColumn("of_source", F.row_number().over(own)).where("coverage > 0 OR lexical > 0 OR of_source = 1").drop("of_source")
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("lexical"), "rank", F.concat_ws(":", "source_id", "start", "end"))
    return raw, kept.withColumn("nth", F.row_number().over(order))


def rendered(kept: Column) -> Column:
    """The text of a bundle's items, in order."""
    one = lambda x: F.concat(F.lit('<evidence kind="'), x["kind"], F.lit('" sources="'), x["source_id"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit('" candidates="'), F.array_join(x["candidate_ids"], ","), F.lit('">\n'), x["text"], F.lit("\n</evidence>"))
    return F.array_join(F.transform(kept, one), "\n\n")


def compile_bundles(questions: DataFrame, candidates: DataFrame, sources: DataFrame, cap: int, tokens=word_tokens) -> DataFrame:
    """One bundle for each question whose sources all resolve.

    Returns (query_id, status, kept, dropped, input_tokens, evidence_tokens, source_ids, context, gap, satisfied): status is raw where
    the whole sources fit, extract where sentences were admitted, impossible where the question alone is over the cap or
    nothing fits what it needs; kept is an array of items, dropped the sorted ids of candidates of skipped ones. Questions with a
    source that is missing, inactive or changed have status unavailable and no items.
    """
    rows = resolved(candidates, sources)
    broken = rows.groupBy("query_id").agg(F.bool_and("found").alias("whole"))
    raw, extracts = items(questions, rows.where("found"))
    # the items of one question are bounded by the candidates that it was given
    item = F.struct("nth", (tokens(F.col("text")) + FRAME).cast("long").alias("size"), "kind", "source_id", "start", "end", "text", "candidate_ids")
    listed = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias(name))
    q = questions.select("query_id", "query", tokens(F.col("query")).cast("long").alias("static"), needs.need(F.col("query")).alias("need"))
    both = q.join(broken, "query_id", "left").join(listed(raw, "raw"), "query_id", "left").join(listed(extracts, "extracts"), "query_id", "left")
    none = F.filter(F.col("raw"), lambda x: F.lit(False))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x["size"])
    fits = (F.col("static") + total(F.col("raw"))) <= cap
    both = both.withColumn("room", cap - F.col("static")).withColumn("chosen", F.when(fits, F.col("raw")).otherwise(admit(F.col("extracts"), F.col("room"))))
    n = F.col("need")
    asks = (F.size(n["entities"]) > 0) | (F.size(n["times"]) > 0) | (F.size(n["operands"]) > 0) | n["count"].isNotNull() | (n["state"] != "")
    status = F.when(~F.coalesce("whole", F.lit(False)), "unavailable").when((F.col("room") < 0) | (~fits & (F.size("chosen") == 0) & asks), "impossible").when(fits, "raw").otherwise("extract")
    done = both.withColumn("status", status).withColumn("kept", F.when(F.col("status").isin("raw", "extract"), F.col("chosen")).otherwise(none))
    left = F.filter(F.col("extracts"), lambda x: ~F.exists(F.col("kept"), lambda y: y["nth"] == x["nth"]))
    done = done.withColumn("dropped", F.when(F.col("status") == "extract", F.array_sort(F.array_distinct(F.flatten(F.transform(left, lambda x: x["candidate_ids"]))))))
    text = F.array_join(F.transform("kept", lambda x: x["text"]), "\n")
    ids = F.array_sort(F.array_distinct(F.transform("kept", lambda x: x["source_id"])))
    done = done.withColumn("said", text).withColumn("source_ids", ids).withColumn("evidence_tokens", total(F.col("kept")))
    # a bundle's sources with a date, for the gap in time
    dated = rows.where("occurred_at IS NOT NULL").groupBy("query_id").agg(F.collect_set("source_id").alias("with_date"))
    done = done.join(dated, "query_id", "left").withColumn("timed", F.coalesce(F.arrays_overlap("source_ids", "with_date"), F.lit(False)))
    gap = needs.remaining_gap(n, F.col("said"), F.col("timed"))
    return done.select("query_id", "status", "kept", "dropped", (F.col("static") + F.col("evidence_tokens")).alias("input_tokens"), "evidence_tokens", "source_ids", rendered(F.col("kept")).alias("context"), gap.alias("gap"), needs.satisfied(n, F.col("said"), F.size("source_ids")).alias("satisfied"))


def bundle_problems(bundles: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """What is wrong with bundles: (query_id, problem); none where all items can be found again in their sources."""
    flat = bundles.where("status IN ('raw', 'extract')")
    own = flat.select("query_id", F.explode("kept").alias("x")).select("query_id", "x.*").join(sources.select(F.col("id").alias("source_id"), "content", "state"), "source_id", "left")
    cut = F.substr("content", F.col("start") + 1, F.col("end") - F.col("start"))
    whole = (F.col("kind") != "KEEP") | ((F.col("start") == 0) & (F.col("end") == F.length("content")))
    lost = own.where(~F.coalesce((F.col("state") == "active") & (cut == F.col("text")) & whole, F.lit(False))).select("query_id", F.lit("span").alias("problem"))
    over = flat.where(F.col("input_tokens") > cap).select("query_id", F.lit("cap").alias("problem"))
    union = F.array_sort(F.array_distinct(F.transform("kept", lambda x: x["source_id"])))
    drift = flat.where((F.col("source_ids") != union) | (F.col("context") != rendered(F.col("kept")))).select("query_id", F.lit("rendering").alias("problem"))
    return lost.union(over).union(drift).distinct()


def relations(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Relations between the sources of one bundle (query_id, source_id, content, occurred_at): (query_id, kind, left, right, operand).

    before by date; conflicts where one of two is negated and they share two words; supports_operand where both hold a
    word of an operand. A bundle's sources are few, bounded by its token cap.
    """
    q = questions.select("query_id", needs.operands(F.col("query")).alias("operands"))
    r = rows.select("query_id", "source_id", "occurred_at", needs.lexical_words(F.col("content")).alias("w"), negated("content").alias("n"))
    a, b = (r.select("query_id", *[F.col(c).alias(f"{c}_{x}") for c in ("source_id", "occurred_at", "w", "n")]) for x in "ab")
    pairs = a.join(b, "query_id").where("source_id_a < source_id_b").join(q, "query_id")
    row = lambda kind, x, y, operand=F.lit(""): F.struct(F.lit(kind).alias("kind"), F.col(x).alias("left"), F.col(y).alias("right"), operand.alias("operand"))
    first = F.when(F.col("occurred_at_a") < F.col("occurred_at_b"), row("before", "source_id_a", "source_id_b")).when(F.col("occurred_at_a") > F.col("occurred_at_b"), row("before", "source_id_b", "source_id_a"))
    clash = F.when((F.col("n_a") != F.col("n_b")) & (F.size(F.array_intersect("w_a", "w_b")) >= 2), row("conflicts", "source_id_a", "source_id_b"))
    held = F.transform(F.filter("operands", lambda o: needs.supports(F.col("w_a"), o) & needs.supports(F.col("w_b"), o)), lambda o: row("supports_operand", "source_id_a", "source_id_b", o))
    return pairs.select("query_id", F.explode(F.concat(F.array_compact(F.array(first, clash)), held)).alias("r")).select("query_id", "r.*")


def merged_items(actions: DataFrame, raw: DataFrame) -> DataFrame:
    """Sentences that a plan proposes to merge (query_id, nth, text, source_id, start, end) as items: the least rank and all candidates of their sources."""
    own = raw.select("query_id", "source_id", "rank", "candidate_ids")
    joined = actions.join(own, ["query_id", "source_id"], "left")
    return joined.groupBy("query_id", "nth", "text").agg(F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidate_ids")))).alias("candidate_ids"), F.array_sort(F.collect_list(F.struct("source_id", "start", "end"))).alias("spans"))


def planned(base: DataFrame, proposals: DataFrame, problems: DataFrame) -> DataFrame:
    """The need of each question after a plan's proposal: (query_id, need, fallback), the base one with a reason where the plan is absent or not allowed.

    base, proposals: (query_id, need); problems: of the proposed actions.
    """
    bad = problems.select("query_id").distinct().withColumn("bad", F.lit(True))
    both = base.join(proposals.select("query_id", F.col("need").alias("proposed"), F.lit(True).alias("given")), "query_id", "left").join(bad, "query_id", "left")
    merged = needs.merged_need(F.col("need"), F.col("proposed"))
    reason = F.when(F.col("given").isNull(), "planner_unavailable").when(merged.isNull(), "planner_invalid_need").when(F.col("bad"), "planner_invalid_action").otherwise("")
    return both.withColumn("fallback", reason).withColumn("need", F.when(F.col("fallback") == "", merged).otherwise(F.col("need"))).select("query_id", "need", "fallback")
