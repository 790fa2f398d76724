"""Which candidates of a question are shown: by the roles of their claims, from expanded sources, as other representations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import normal_form, query_tokens
from tidemark.operators import retrieval as R

MOST, WINDOW, ANCHORS = 12, 60, 2  # picks, candidates looked at, first ones that are always tried


def _same(a, b, fields):
    return all(a[f] and a[f] == b[f] for f in fields)


def duplicate(a: dict, b: dict) -> bool:
    """Two claims that say the same: entity, slot, value and time, none empty."""
    return _same(a, b, ("entity", "slot", "value", "time"))


def conflicting(a: dict, b: dict) -> bool:
    """Two claims of one entity and slot with another value or time, none empty."""
    return _same(a, b, ("entity", "slot")) and all(x[f] for x in (a, b) for f in ("value", "time")) and (a["value"], a["time"]) != (b["value"], b["time"])


def answers(claim: dict, atom: dict) -> bool:
    return bool(claim["entity"]) and claim["entity"] == atom["entity"] and (not atom["slot"] or claim["slot"] == atom["slot"])


def lures(claims: list[dict], atoms: list[dict]) -> bool:
    """Claims that are all of asked-for entities, and none of an asked-for slot."""
    if not claims or not all(c["entity"] and c["slot"] for c in claims):
        return False
    of = [[a for a in atoms if a["entity"] == c["entity"]] for c in claims]
    return all(of) and not any(answers(c, a) for c, own in zip(claims, of) for a in own)


def by_roles(candidates: list[dict], atoms: list[dict], budget: int, ceiling: int = 0) -> list[int]:
    """Places of the picked candidates (claims, cost), in order: anchors, complements, neutral ones, then lures.

    A candidate that repeats a picked claim without contradicting one is skipped, and so is one that passes the ceiling of costs, by
    default that of the first ones.
    """
    candidates = candidates[:WINDOW]
    budget = min(budget, MOST, len(candidates))
    ceiling = ceiling if ceiling > 0 else sum(c["cost"] for c in candidates[:budget])
    picked, spent, open_ = [], 0, [dict(a) for a in atoms]

    def take(i):
        nonlocal spent, open_
        if len(picked) < budget and i not in picked and spent + candidates[i]["cost"] <= ceiling:
            picked.append(i)
            spent += candidates[i]["cost"]
            open_ = [a for a in open_ if not any(answers(c, a) for c in candidates[i]["claims"])]

    def role(i):
        claims, shown = candidates[i]["claims"], [c for j in picked for c in candidates[j]["claims"]]
        clash = any(conflicting(c, d) for c in claims for d in shown)
        again = not clash and any(duplicate(c, d) for c in claims for d in shown)
        useful = any(answers(c, a) for c in claims for a in open_)
        return again, useful, not useful and lures(claims, atoms)

    for i in range(min(ANCHORS, len(candidates))):
        take(i)
    for wanted in (lambda useful, lure: useful, lambda useful, lure: not lure, lambda useful, lure: lure):
        for i in range(ANCHORS, len(candidates)):
            if i not in picked:
                again, useful, lure = role(i)
                if not again and wanted(useful, lure):
                    take(i)
    return picked


def select_roles(candidates: DataFrame, claims: DataFrame, atoms: DataFrame, budget: int) -> DataFrame:
    """(query_id, place, name): candidates (query_id, rank, name, cost) picked by the roles of their claims (name, entity, slot, value, time) for atoms (query_id, entity, slot)."""
    fields = ("entity", "slot", "value", "time")
    clean = claims.select("name", *[normal_form(F.coalesce(f, F.lit(""))).alias(f) for f in fields])
    own = clean.groupBy("name").agg(F.collect_list(F.struct(*fields)).alias("claims"))
    near = candidates.where(F.col("rank") <= WINDOW).join(own, "name", "left")
    asked = atoms.select("query_id", normal_form("entity").alias("entity"), normal_form("slot").alias("slot")).groupBy("query_id").agg(F.collect_list(F.struct("entity", "slot")).alias("atoms"))
    kind, name = dict(candidates.dtypes)["query_id"], dict(candidates.dtypes)["name"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "name"])
        read = lambda xs: [dict(x) if isinstance(x, dict) else x.asDict() for x in (xs if xs is not None else [])]
        rows = [{"claims": read(c), "cost": int(n)} for c, n in zip(pdf["claims"], pdf["cost"])]
        picks = by_roles(rows, read(pdf["atoms"].iloc[0]), budget)
        return pd.DataFrame([(pdf["query_id"].iloc[0], k + 1, pdf["name"].iloc[i]) for k, i in enumerate(picks)], columns=["query_id", "place", "name"])

    # WINDOW rows of a query at most
    return near.join(asked, "query_id", "left").select("query_id", "rank", "name", "cost", "claims", "atoms").groupBy("query_id").applyInPandas(run, f"query_id {kind}, place int, name {name}")


def demand_atoms(queries: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity): what a query asks for: its tokens that are entities of its candidates, and the entities that it names."""
    own = candidates.select("query_id", F.col("name").alias("entry")).join(entities.select("entry", "entity").distinct(), "entry").select("query_id", "entity")
    tokens = queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("entity"))
    return tokens.join(own, ["query_id", "entity"], "left_semi").union(R.whole_query_signal(queries, entities)[0].select("query_id", "entity")).distinct()


def expanded(hits: DataFrame, lineage: DataFrame, evidence: DataFrame) -> DataFrame:
    """The sources of hits (query_id, rank, projection_id) as items: (query_id, nth, projection_id, evidence_id, text, kind, found).

    lineage: (projection_id, source_order, evidence_id, start, end), null bounds: the whole. nth runs through all items of a query by
    hit and source order; found is false where a source is missing, inactive or too short for its span.
    """
    e = evidence.select(F.col("id").alias("evidence_id"), "content", "state")
    j = hits.join(lineage, "projection_id").join(e, "evidence_id", "left")
    whole = F.col("start").isNull()
    text = F.when(whole, F.col("content")).otherwise(F.substr("content", F.col("start") + 1, F.col("end") - F.col("start")))
    good = F.coalesce((F.col("state") == "active") & (whole | ((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("content")))), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "projection_id", "source_order", "evidence_id"))
    return j.select("query_id", nth.alias("nth"), "rank", "projection_id", "evidence_id", "source_order", text.alias("text"), F.when(whole, "KEEP").otherwise("EXTRACT").alias("kind"), good.alias("found"))


def folded(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items of hits whose sources are all kept whole as one item with the hit's own text (projection_id, content): (query_id, projection_id, kind, text, sources)."""
    rows = items.groupBy("query_id", "projection_id").agg(F.bool_and(F.col("kind") == "KEEP").alias("whole"), F.array_sort(F.collect_list(F.struct("source_order", "evidence_id", "kind", "text"))).alias("parts"))
    rows = rows.join(texts, "projection_id", "left")
    one = F.array(F.struct(F.lit("KEEP").alias("kind"), F.col("content").alias("text"), F.transform("parts", lambda x: x["evidence_id"]).alias("sources")))
    each = F.transform("parts", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), F.array(x["evidence_id"]).alias("sources")))
    return rows.select("query_id", "projection_id", F.explode(F.when(F.col("whole"), one).otherwise(each)).alias("x")).select("query_id", "projection_id", "x.*")


def budgets(queries: DataFrame, overrides: DataFrame, top: int, quota: int) -> DataFrame:
    """Queries (category, ...) with top and quota, by category where overrides (category, top, quota) has it."""
    o = overrides.select("category", F.col("top").alias("__top"), F.col("quota").alias("__quota"))
    return queries.join(o, "category", "left").withColumn("top", F.coalesce("__top", F.lit(top))).withColumn("quota", F.coalesce("__quota", F.lit(quota))).drop("__top", "__quota")


def chosen_chunks(hits: DataFrame, is_chunk: Column, selector, k: int, quota: int, most: int = WINDOW) -> DataFrame:
    """The k best with a selector in charge of the chunks: hits (query_id, name, score); selector: a function of the first chunks (query_id, name, score, rank) to those it keeps.

    Kept chunks come in the selector's order of place; other hits fill what they leave, as with_quota does.
    """
    kind = hits.withColumn("chunk", is_chunk)
    ranked = kind.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "chunk").orderBy(F.desc("score"), "name")))
    kept = selector(ranked.where(F.col("chunk") & (F.col("rank") <= most)).drop("chunk")).select("query_id", "name").withColumn("kept", F.lit(True))
    some = ranked.join(kept, ["query_id", "name"], "left").where(~F.col("chunk") | F.col("kept"))
    return R.with_quota(some.select("query_id", "name", "score", "chunk"), k, quota, F.col("chunk"))


def candidate_lines(results: DataFrame, lineage: DataFrame, sources: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each query as a planner reads it: (query_id, candidates, sources, gold, covered), candidates ranked from 0 with their source ids.

    results: (query_id, rank, name, score, content, projection_id); lineage and sources by projection_id and id; gold: (query_id, evidence_id).
    """
    refs = lineage.groupBy("projection_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("source_ids"))
    rows = results.join(refs, "projection_id", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))
    lines = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("rank"), "name", "score", F.col("content").alias("text"), F.sha2("content", 256).alias("text_digest"), "source_ids"))).alias("candidates"))
    used = rows.select("query_id", F.explode("source_ids").alias("id")).distinct().join(sources, "id")
    told = used.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("session", "ordinal", F.sha2("content", 256).alias("digest")))))).alias("sources"))
    g = gold.join(used.select("query_id", F.col("id").alias("evidence_id"), F.lit(1).alias("hit")), ["query_id", "evidence_id"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("gold"), F.count("hit").alias("covered"))
    return lines.join(told, "query_id", "left").join(g, "query_id", "left")


def chosen_questions(questions: DataFrame, by: str, order: str, only: DataFrame | None = None, category: int | None = None, enumerating: bool = False, most: int = 0, adversarial: int = -1) -> DataFrame:
    """The questions of a run: (by, order, id, text, category, adversarial, ...) restricted to ids (id), a category and enumerating ones.

    Of each `by` the first `most` answerable questions in order stay (0: all), and the first `adversarial` unanswerable ones (below 0:
    all, 0: none); both limits count what the other restrictions leave.
    """
    from tidemark.functions.intent import enumerates

    q = questions
    if only is not None:
        q = q.join(only.select("id").distinct(), "id", "left_semi")
    if category is not None and category > 0:
        q = q.where(F.col("category") == category)
    if enumerating:
        q = q.where(enumerates(F.col("text")))
    nth = F.row_number().over(Window.partitionBy(by, "adversarial").orderBy(order, "id"))
    free = F.lit(True) if most <= 0 else F.col("nth") <= most
    other = F.lit(True) if adversarial < 0 else F.col("nth") <= adversarial
    return q.withColumn("nth", nth).where(F.when(F.col("adversarial"), other).otherwise(free)).drop("nth")
