"""Entity graph: edges, neighbours, bounded walks and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.components import connected_components


def co_edges(entities: DataFrame, entry: str = "entry", entity: str = "entity") -> DataFrame:
    """Pairs of entities of one entry, in order, weighted by the entries that have both.

    An entry's entities are gathered once and paired from there, so that a table dealt by entry is neither dealt nor sorted for a join with itself.
    """
    held = entities.where(F.col(entry).isNotNull()).groupBy(entry).agg(F.sort_array(F.collect_set(entity)).alias("t")).where(F.size("t") > 1)
    first = held.select(F.posexplode("t").alias("i", "entity_a"), "t")
    pairs = first.select("entity_a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("entity_b"))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count("*").cast("double").alias("weight"))


def accumulate(edges: DataFrame) -> DataFrame:
    """Normalise and merge edges (a, b, kind, weight, ts): loops, blanks and unknown kinds go, co adds up, syn keeps the last."""
    a, b = F.lower(F.trim("a")), F.lower(F.trim("b"))
    rows = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "kind", F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight")).alias("weight"), "ts")
    rows = rows.where("a <> b AND a <> '' AND kind IN ('co', 'syn')")
    return rows.groupBy("a", "b", "kind").agg(F.sum("weight").alias("total"), F.max_by("weight", "ts").alias("last")).select("a", "b", "kind", F.when(F.col("kind") == "co", F.col("total")).otherwise(F.col("last")).alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("entity_a").alias("src"), F.col("entity_b").alias("dst"), "weight")
    return one.union(edges.select(F.col("entity_b").alias("src"), F.col("entity_a").alias("dst"), "weight"))


def walk(seeds: DataFrame, edges: DataFrame, frequency: DataFrame, depth: int = 2) -> DataFrame:
    """Scores of entities within depth steps of the seeds, which score the inverse of their document frequency.

    Each step adds score times weight to entities not visited by earlier steps; seeds have no result.
    """
    links = mirrored(edges).where("weight > 0")
    level = seeds.join(frequency, "entity").where("df > 0").select(F.col("entity"), (1.0 / F.col("df")).alias("score"))
    visited = seeds.select("entity")
    out = None
    for _ in range(depth):
        step = level.join(links, level["entity"] == links["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
        level = step.select(F.col("dst").alias("entity"), "score").join(visited, "entity", "left_anti")
        out = level if out is None else out.union(level)
        visited = visited.union(level.select("entity"))
    return out


def entry_scores(scores: DataFrame, entities: DataFrame, cap: int = 200) -> DataFrame:
    """Sum of the scores of an entry's entities, of the cap best ones."""
    best = scores.orderBy(F.desc("score"), "entity").limit(cap)
    return best.join(entities, "entity").groupBy("entry").agg(F.sum("score").alias("score"))


def clusters(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Connected groups of two or more: (component, name), by pairs (src, dst) of ids and names (id, name)."""
    placed = connected_components(pairs)
    return placed.join(names, placed["node"] == names["id"]).select("component", "name")


def seed_clusters(rows: DataFrame, group: str, bound: int = 8, floor: float = 0.25) -> DataFrame:
    """Greedy clusters within a group: each unassigned row in order of position takes up to bound - 1 later ones that
    share enough of its tokens. rows: (group, position, id, tokens); groups are handled one by one and must be small."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        items = [(i, set(t)) for i, t in zip(pdf["id"], pdf["tokens"])]
        taken, out = set(), []
        for i, own in items:
            if i in taken or not own:
                continue
            members = [j for j, t in items if j != i and j not in taken and t and len(own & t) / len(own | t) >= floor][: bound - 1]
            if members:
                taken.update([i, *members])
                out += [(pdf[group].iloc[0], i, m) for m in [i, *members]]
        return pd.DataFrame(out, columns=[group, "seed", "member"])

    kind = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, seed {kind['id']}, member {kind['id']}")


def overlay(unclaimed: DataFrame, centres: DataFrame, least: float = 0.9, bound: int | None = None) -> DataFrame:
    """The most similar centre of each unclaimed row, of equal ones the later, if its cosine is `least` or more: (id, centre, sim).

    unclaimed: (id, v) and, with a bound, position; centres: (centre, v) and, with a bound, members, how many a cluster has already. A cluster
    takes rows in order of position until it has `bound` members; a row that finds its best cluster full stays
    unclaimed, it does not go to the next. Rows and centres meet in blocks; each block passes on a row's best only.
    """
    from tidemark.operators.retrieval import blocks_cosine

    met = blocks_cosine(centres.select(F.col("centre").alias("name"), F.col("v").cast("array<double>").alias("v")), unclaimed.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("v")), 1)
    near = met.select(F.col("query_id").alias("id"), F.col("name").alias("centre"), F.round("cos", 9).alias("sim")).where(F.col("sim") >= least)
    best = near.groupBy("id").agg(F.max(F.struct("sim", "centre")).alias("x")).select("id", "x.centre", "x.sim")
    if bound is None:
        return best
    queue = best.join(unclaimed.select("id", "position"), "id")
    # of each centre `bound` rows at most leave a task; only then the places that are left count
    queue = queue.withColumn("nth", F.row_number().over(Window.partitionBy("centre").orderBy("position", "id"))).where(F.col("nth") <= bound)
    return queue.join(centres.select("centre", "members"), "centre").where(F.col("nth") <= F.lit(bound) - F.col("members")).select("id", "centre", "sim")
