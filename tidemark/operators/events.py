"""Extracted events: validation, anchoring audits and rendering. An event is JSON of facts and relations with its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import ascii_bounds, json_object, one_line

SCHEMA = "event_id string, conversation_id string, source_ledger_ids array<string>, speaker string, fact_entries array<struct<text:string>>, relation_entries array<struct<relation_type:string,subject:string,object:string,text:string>>, absolute_ts string, relative_ref string"
# Kinds of relations, sizes in code points, and words that tell a time.
RELATIONS = ("interpersonal", "causal", "co_participation", "temporal_order", "preference")
MOST_TEXT, MOST_TOTAL, MOST_RENDERED = 500, 2000, 4000
TIME_WORDS = (
    r"(?i)\b(yesterday|today|tomorrow|last\s+(week|month|year|night|friday|saturday|sunday|monday|tuesday|wednesday|thursday|weekend)|this\s+(week|month|year|morning|afternoon|evening|night|weekend)|"
    r"next\s+(week|month|year|weekend|friday|saturday|sunday|monday|tuesday|wednesday|thursday)|ago|recently|earlier|later|a few days|a couple of (weeks|days|months))\b"
)


def parsed(text: Column, lenient: bool = False) -> Column:
    """The event that a model's text holds, null where it is no JSON; leniently without relations of other kinds."""
    e = F.from_json(json_object(text), SCHEMA)
    if not lenient:
        return e
    return e.withField("relation_entries", F.filter(e["relation_entries"], lambda r: r["relation_type"].isin(*RELATIONS)))


def problem(e: Column) -> Column:
    """The first thing that is wrong with an event; null where it is sound."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ids, facts = e["source_ledger_ids"], F.coalesce(e["fact_entries"], F.array().cast("array<struct<text:string>>"))
    relations = F.coalesce(e["relation_entries"], F.array().cast("array<struct<relation_type:string,subject:string,object:string,text:string>>"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    total = F.aggregate(facts, F.lit(0), lambda n, f: n + size(f["text"])) + F.aggregate(relations, F.lit(0), lambda n, r: n + size(r["text"]) + size(r["subject"]) + size(r["object"]))
    checks = {
        "malformed": e.isNull(), "conversation_id": blank(e["conversation_id"]), "source_ledger_ids": F.coalesce(F.size(ids) <= 0, F.lit(True)) | F.exists(ids, blank), "speaker": blank(e["speaker"]), "fact_entries": F.size(facts) == 0,
        "fact text": F.exists(facts, lambda f: (size(f["text"]) == 0) | (size(f["text"]) > MOST_TEXT)), "relation_type": F.exists(relations, lambda r: ~F.coalesce(r["relation_type"].isin(*RELATIONS), F.lit(False))),
        "relation": F.exists(relations, lambda r: blank(r["subject"]) | blank(r["object"]) | blank(r["text"]) | (size(r["text"]) > MOST_TEXT)), "size": total > MOST_TOTAL,
    }
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()])


def extracted(rows: DataFrame, text: str, lenient: bool = True) -> DataFrame:
    """Rows with the event of a text and what is wrong with it: columns event (null where anything is) and problem."""
    out = rows.withColumn("event", parsed(F.col(text), lenient)).withColumn("problem", problem(F.col("event")))
    return out.withColumn("event", F.when(F.col("problem").isNull(), F.col("event")))


def anchoring(events: DataFrame, by: list[str]) -> DataFrame:
    """How often events (event) that speak of a time are anchored to a date: counts and rates."""
    e = F.col("event")
    says = F.exists(e["fact_entries"], lambda f: f["text"].rlike(ascii_bounds(TIME_WORDS))) | F.coalesce(F.exists(e["relation_entries"], lambda r: r["text"].rlike(ascii_bounds(TIME_WORDS))), F.lit(False)) | (F.coalesce(e["relative_ref"], F.lit("")) != "")
    anchored = F.coalesce(e["absolute_ts"], F.lit("")) != ""
    rows = events.withColumn("says", F.coalesce(says, F.lit(False))).withColumn("anchored", anchored).withColumn("bad", anchored & ~e["absolute_ts"].rlike(r"^\d{4}-\d{2}-\d{2}$"))
    g = rows.groupBy(*by).agg(F.count("*").alias("events"), F.count_if("anchored").alias("anchored"), F.count_if("says").alias("timely"), F.count_if(F.col("says") & F.col("anchored")).alias("both"), F.count_if("bad").alias("bad_format"), F.count_if(problem(F.col("event")).isNull()).alias("legal"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return g.select(*by, "events", "anchored", "timely", "bad_format", "legal", rate("anchored", "events").alias("rate"), rate("both", "timely").alias("timely_rate"))


def rendered(events: DataFrame, key: str, most: int = MOST_RENDERED) -> DataFrame:
    """The text of each conversation's events, in order of their sources, cut at most code points: (key, text)."""
    e = F.col("event")
    order = Window.partitionBy(key).orderBy(F.array_join(e["source_ledger_ids"], ","))
    head = F.concat(F.lit("[EVENT "), F.row_number().over(order).cast("string"), F.lit("] (speaker: "), e["speaker"], F.when(F.coalesce(e["absolute_ts"], F.lit("")) != "", F.concat(F.lit(", "), e["absolute_ts"])).otherwise(""),
                    F.when(F.coalesce(e["relative_ref"], F.lit("")) != "", F.concat(F.lit(', rel: "'), e["relative_ref"], F.lit('"'))).otherwise(""), F.lit(")\n"))
    line = lambda c: one_line(c, 1 << 30)
    facts = F.array_join(F.transform(e["fact_entries"], lambda f: F.concat(F.lit("  FACT: "), line(f["text"]), F.lit("\n"))), "")
    relations = F.coalesce(F.array_join(F.transform(e["relation_entries"], lambda r: F.concat(F.lit("  RELATION ("), r["relation_type"], F.lit("): "), line(r["text"]), F.lit("\n"))), ""), F.lit(""))
    rows = events.withColumn("nth", F.row_number().over(order)).withColumn("text", F.concat(head, facts, relations))
    # only as many events as fit are gathered
    upto = F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") <= most)
    whole = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.select(key, F.substring("text", 1, most).alias("text"))
