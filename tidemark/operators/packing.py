"""Order-dependent folds: packing under budgets and chunks of sessions, where a group is handled at once and must be small, and greedy coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.work import Work

TARGET, LIMIT = 900, 1100  # code points of a chunk


def prefix_within(rows: DataFrame, by: list[str], order: list, size: Column, budget: Column | int) -> DataFrame:
    """Rows up to the first with which the running total passes the budget; that one and all after it go."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)


def admit(items: Column, budget: Column | int) -> Column:
    """Of an array of structs with a size, those admitted in order while they fit: one that does not is skipped."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.filter(items, lambda x: F.lit(False)).alias("kept"))

    def step(acc, x):
        fits = acc["total"] + x["size"] <= budget
        return F.struct((acc["total"] + F.when(fits, x["size"]).otherwise(0)).cast("long").alias("total"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def pack(turns: list[tuple[int, str]]) -> list[tuple[str, list[int]]]:
    """Chunks of a session's turns: filled to TARGET while they stay within LIMIT; a longer turn is cut alone."""
    out, held, places, size = [], [], [], 0

    def flush():
        nonlocal held, places, size
        if held:
            out.append(("\n".join(held), places))
        held, places, size = [], [], 0

    for place, text in turns:
        if not text.strip():
            continue
        if len(text) > LIMIT:
            flush()
            out.extend((text[i : i + TARGET], [place]) for i in range(0, len(text), TARGET))
            continue
        if held and size + 1 + len(text) > LIMIT:
            flush()
        size += len(text) + bool(held)
        held.append(text)
        places.append(place)
        if size >= TARGET:
            flush()
    flush()
    return out


def chunks(turns: DataFrame, session: str, place: str, text: str) -> DataFrame:
    """Chunks of every session: (session, nth, name, text, first, last)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        rows = pack(list(zip(pdf["place"].tolist(), pdf["text"].fillna("").tolist())))
        key = pdf["session"].iloc[0]
        return pd.DataFrame([(key, i, f"chunk-s{key}-{i:03d}", t, p[0], p[-1]) for i, (t, p) in enumerate(rows)], columns=["session", "nth", "name", "text", "first", "last"])

    renamed = turns.select(F.col(session).alias("session"), F.col(place).alias("place"), F.col(text).alias("text"))
    return renamed.groupBy("session").applyInPandas(run, "session long, nth int, name string, text string, first long, last long")


def cover(rows: DataFrame, group: str, most: int = 12) -> DataFrame:
    """Greedy coverage: again and again the candidate that covers most items not covered, the first of equal ones.

    rows: (group, position, id, items), ids unique within a group, which is not null; returns (group, pick, id, gained). A round makes a pick of every group.
    Candidates' items are written once and only read after that; a round writes the items that its picks cover, one candidate's
    for each group, and the gains of all candidates less what they hold of these. So no group is gathered.
    """
    work = Work(rows.sparkSession, "cover")
    held = work.write(rows.select(group, "position", "id", F.explode(F.array_distinct("items")).alias("item")), "held")
    gains = work.write(held.groupBy(group, "position", "id").agg(F.count("*").cast("int").alias("gained")), "gains0")
    out = covered = None
    for pick in range(1, most + 1):
        best = gains.where("gained > 0").groupBy(group).agg(F.max_by(F.struct("id", "gained"), F.struct(F.col("gained"), -F.col("position"))).alias("x"))
        best = work.write(best.select(group, F.lit(pick).alias("pick"), "x.id", "x.gained"), f"pick{pick}")
        if best.isEmpty():
            break
        out = best if out is None else out.unionByName(best)
        if pick == most:
            return out
        # null is an item too, that no join meets: it is open for ever
        done = held.join(best.select(group, "id"), [group, "id"], "left_semi").select(group, "item")
        done = work.write(done if covered is None else done.join(covered, [group, "item"], "left_anti"), f"done{pick}")
        covered = done if covered is None else covered.unionByName(done)
        less = held.join(done, [group, "item"]).groupBy(group, "id").agg(F.count("*").cast("int").alias("less"))
        gains = work.write(gains.join(less, [group, "id"], "left").select(group, "position", "id", (F.col("gained") - F.coalesce("less", F.lit(0))).alias("gained")), f"gains{pick}")
        work.drop(f"gains{pick - 1}")
    return out if out is not None else best
