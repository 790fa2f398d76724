"""Evidence, projections and entries: lifecycle states, lineage joins and writes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

NEXT = {("active", "tombstone"): "tombstoned", ("tombstoned", "restore"): "active", ("active", "purge"): "purged", ("tombstoned", "purge"): "purged"}
ACTIONS = ("append", "tombstone", "restore", "purge")


def active(projections: DataFrame) -> DataFrame:
    return projections.where("state = 'active'")


def fail_closed(candidates: DataFrame, projections: DataFrame, key: str) -> DataFrame:
    """Candidates with an active atomic fact of their own; all others are dropped."""
    return candidates.join(active(projections).where("kind = 'atomic_fact'").select(F.col("id").alias(key)), key, "left_semi")


def heads(log: DataFrame) -> DataFrame:
    """State of each item after its last event (item, seq, action); events that no state allows are ignored.

    The machine has four states, so that a run of events acts on it as a map of states; the fold below is
    over the events of one item, in order.
    """
    steps = F.sort_array(F.collect_list(F.struct("seq", "action")))
    state = F.lit("none")
    rule = lambda s, e: F.when((s == "none") & (e["action"] == "append"), "active")

    def fold(s, e):
        out = rule(s, e)
        for (before, action), after in NEXT.items():
            out = out.when((s == before) & (e["action"] == action), after)
        return out.otherwise(s)

    return log.groupBy("item").agg(steps.alias("steps"), F.max("seq").alias("last_seq")).select("item", F.aggregate("steps", state, fold).alias("state"), "last_seq")


def stale_after(projections: DataFrame, lineage: DataFrame, evidence: DataFrame, touched: DataFrame) -> DataFrame:
    """Active projections with a touched source and no source left that is active: they become stale."""
    living = lineage.join(evidence.where("state = 'active'").select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select("projection_id").distinct()
    met = lineage.join(touched, "evidence_id", "left_semi").select("projection_id").distinct()
    found = active(projections).join(met, F.col("id") == F.col("projection_id"), "left_semi")
    return found.join(living, F.col("id") == F.col("projection_id"), "left_anti")


def siblings(lineage: DataFrame, projections: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """Other active facts that share evidence with a seed, by its least source order and then id."""
    a = lineage.join(seeds.select(F.col("projection_id").alias("seed")), F.col("projection_id") == F.col("seed")).select("seed", "evidence_id", F.col("source_order").alias("place"))
    b = lineage.join(active(projections).where("kind = 'atomic_fact'"), F.col("projection_id") == F.col("id"), "left_semi").select("evidence_id", "projection_id")
    met = a.join(b, "evidence_id").where("seed <> projection_id").groupBy("seed", "projection_id").agg(F.min("place").alias("place"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("place", "projection_id"))).where(F.col("rank") <= most)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Entries after a write: created_at, hit_count and last_used_at of old rows stay, other columns are overwritten, revision grows by one."""
    kept = ("created_at", "hit_count", "last_used_at", "superseded_by")
    renamed = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in key])
    fresh = F.col("__new").isNotNull()
    both = new.withColumn("__new", F.lit(1)).join(renamed, key, "full_outer")
    out = [*key]
    for c in new.columns:
        if c in key:
            continue
        if c in kept:
            out.append(F.coalesce(f"old_{c}", c).alias(c))
        elif c == "revision":
            out.append(F.when(fresh, F.coalesce(F.col("old_revision") + 1, F.lit(1))).otherwise(F.col("old_revision")).alias(c))
        else:
            out.append(F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
    return both.select(*out)


def merge_refs(existing: DataFrame, incoming: DataFrame, key: str = "projection_id") -> DataFrame:
    """Source references of both, the first of each evidence, numbered again from 0."""
    both = existing.select(key, "evidence_id", F.lit(0).alias("side"), "source_order").union(incoming.select(key, "evidence_id", F.lit(1).alias("side"), "source_order"))
    first = both.groupBy(key, "evidence_id").agg(F.min(F.struct("side", "source_order")).alias("at"))
    return first.select(key, "evidence_id", (F.row_number().over(Window.partitionBy(key).orderBy("at", "evidence_id")) - 1).cast("long").alias("source_order"))


def bump_usage(entries: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Entries with uses (key, at) counted in; uses of unknown entries are ignored."""
    counted = uses.groupBy(key).agg(F.count("*").alias("more"), F.max("at").alias("latest"))
    out = entries.join(counted, key, "left")
    return out.withColumn("hit_count", F.col("hit_count") + F.coalesce("more", F.lit(0))).withColumn("last_used_at", F.greatest("last_used_at", "latest")).drop("more", "latest")


def purge(evidence: DataFrame, projections: DataFrame, lineage: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence without the contents of the ids, and projections and lineage without all that any of them is a source of."""
    gone = lineage.join(ids, "evidence_id", "left_semi").select("projection_id").distinct()
    marked = evidence.join(ids.select(F.col("evidence_id").alias("id")).withColumn("__gone", F.lit(True)), "id", "left")
    cleared = marked.withColumn("content", F.when(F.col("__gone").isNull(), F.col("content"))).withColumn("state", F.when(F.col("__gone"), "purged").otherwise(F.col("state"))).drop("__gone")
    return cleared, projections.join(gone, F.col("id") == F.col("projection_id"), "left_anti"), lineage.join(gone, "projection_id", "left_anti")


def supersede(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set superseded_by as decided (loser, winner): pinned and self-superseding losers stay, winners must exist."""
    valid = decisions.where("loser <> winner").join(entries.select(F.col("name").alias("winner")), "winner", "left_semi").groupBy("loser").agg(F.max("winner").alias("winner"))
    out = entries.join(valid, F.col("name") == F.col("loser"), "left")
    return out.withColumn("superseded_by", F.when(~F.col("pinned") & F.col("winner").isNotNull(), F.col("winner")).otherwise(F.col("superseded_by"))).drop("loser", "winner")
