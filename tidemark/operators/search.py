"""The whole search as one plan over many queries: signals, fusion, filters, re-weights, sweep, rerank and cut.

Queries: (query_id, text, vec, now, k); vec and now may be null. A memory is a dict of tables: entries (name, id, trigger, content, updated_at,
event_start, event_end, superseded_by), vectors (name, vec), entities (entry, entity, raw), projections (id, object_key, state,
kind), and where their signals are asked for aliases (entry, text) and edges (entity_a, entity_b, weight). Under "keywords" it may hold a KeywordIndex of name, trigger and content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import intent, keywords as K
from tidemark.functions.dates import TAU_DAYS, bounds, decay, intersects
from tidemark.operators import graph as G, retrieval as R
from tidemark.work import Work


@dataclass
class Options:
    """What a search does beyond three signals and fusion; nothing by default."""

    temporal: bool = False
    hard_filter: bool = False
    tau_days: float = TAU_DAYS
    penalty: float = 0.0
    associative: bool = False
    sweep: bool = False
    model: str | None = None  # of the vectors that count; of all, where it is not given
    reranker: Callable | None = None  # of a frame (query_id, text, name, content): (query_id, name, score)


def normalised(queries: DataFrame) -> DataFrame:
    """Queries with texts trimmed, without blank ones, and k above 0."""
    q = queries.withColumn("text", F.trim("text")).where("text <> ''")
    return q.withColumn("k", F.when(F.col("k") > 0, F.col("k")).otherwise(R.DEFAULT_K))


def distinct_texts(subqueries: DataFrame) -> DataFrame:
    """Sub-queries (query_id, sub_id, text) trimmed, blank ones and repeats gone, the first of each staying."""
    t = subqueries.withColumn("text", F.trim("text")).where("text <> ''")
    return t.groupBy("query_id", "text").agg(F.min("sub_id").alias("sub_id")).select("query_id", "sub_id", "text")


def _pool(q: DataFrame) -> DataFrame:
    return q.select("query_id", F.greatest(F.lit(100), 10 * F.col("k")).alias("pool"))


def _within(ranked: DataFrame, q: DataFrame) -> DataFrame:
    return ranked.join(_pool(q), "query_id").where("rank <= pool").drop("pool")


def keyword_ranks(memory: dict, q: DataFrame) -> DataFrame:
    """(query_id, name, rank) by BM25, or of fragments where the plan falls back to them."""
    entries = memory["entries"]
    most = max(100, 10 * (q.agg(F.max("k")).first()[0] or 10))
    bm = R.bm25(entries, q, ("name", "trigger", "content"), index=memory.get("keywords"), limit=most)
    ranked = R.top(bm, ["query_id"], [F.desc(F.round("score", 9)), "name"], most).select("query_id", "name", "rank")
    return _within(ranked.union(R.fragments(entries, q, most)), q)


def alias_ranks(aliases: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, name, rank) of entries whose alias holds a fragment of the query: fragment by fragment, each by BM25 over all aliases, then name.

    Of each fragment as many aliases count as the query's pool holds; an entry stands where it first comes.
    """
    limit = F.greatest(F.lit(100), 10 * F.col("k")) if "k" in q.columns else F.lit(R.pool(R.DEFAULT_K))
    asked = q.select("query_id", limit.alias("pool"), F.posexplode(F.transform(K.runs(F.col("text")), F.lower)).alias("place", "part")).where(F.length("part") >= K.LEAST)
    rows = aliases.select(F.col("entry").alias("name"), F.lower("text").alias("alias")).withColumn("dl", F.greatest(F.length("alias") - 2, F.lit(0)).cast("double"))
    stats = rows.agg(F.count("*").cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))
    places = F.transform(F.sequence(F.lit(1), F.length("alias") - 2), lambda i: F.substr("alias", i, F.lit(3)))
    grams = rows.where(F.length("alias") >= K.LEAST).withColumn("gram", F.explode(F.array_distinct(places)))
    parts = asked.select("part").distinct().withColumn("gram", F.substring("part", 1, 3))
    met = grams.join(parts, "gram").where(F.contains("alias", "part")).select("part", "name", "alias", "dl", R.occurrences(F.col("alias"), F.col("part")).cast("double").alias("tf"))
    df = met.groupBy("part").agg(F.count("*").cast("double").alias("df"))
    scored = met.join(df, "part").crossJoin(F.broadcast(stats)).select("part", "name", "alias", R.bm25_term().alias("score"))  # stats: one row
    by = Window.partitionBy("query_id", "place").orderBy(F.desc(F.round("score", 9)), "name", "alias")
    ranked = asked.join(scored, "part").withColumn("nth", F.row_number().over(by)).where("nth <= pool")
    first = ranked.groupBy("query_id", "name").agg(F.min(F.struct("place", "nth")).alias("at"))
    return first.select("query_id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "name")).alias("rank"))


NAMED = 32  # characters of a name by which texts are looked through
SLOT_BITS = 20


def _runs_of(text: str, n: int) -> np.ndarray:
    """A slot for each run of n characters of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.int64)
    h = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(batches):
    """The slots of the task's names, by their length: one bitmap for each."""
    found = {}
    for batch in batches:
        for x in batch.column(0).to_pylist():
            found.setdefault(len(x), np.zeros(1 << SLOT_BITS, bool))[_runs_of(x, len(x))[0]] = True
    if found:
        yield pa.RecordBatch.from_pydict({"n": pa.array(list(found), pa.int32()), "bits": pa.array([np.packbits(b).tobytes() for b in found.values()], pa.binary())})


def _either(table: pa.Table) -> pa.Table:
    out = np.zeros(1 << SLOT_BITS >> 3, np.uint8)
    for x in table["bits"].to_pylist():
        out |= np.frombuffer(x, np.uint8)
    return pa.table({"n": table["n"].slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})


def _parts_of(batches, packed):
    """The distinct runs of an entry's text that may be a name: (name, part)."""
    bits = {n: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for n, b in packed.items()}
    for batch in batches:
        of, parts = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for n, b in bits.items():
                own = {text[j : j + n] for j in np.flatnonzero(b[_runs_of(text, n)])}
                of += [i] * len(own)
                parts += own
        yield pa.RecordBatch.from_pydict({"name": batch.column(0).take(pa.array(of, pa.int32())), "part": pa.array(parts, pa.string())})


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Where texts (name, said) hold names (entity) as parts: (name, entity). Both are taken as they are; names are not empty.

    Each text is looked through once for each length of a name's first NAMED characters, by bitmaps of fixed size, one for
    each length; runs that pass are joined to the names, and longer names are looked for in the texts of such runs.
    """
    spark = texts.sparkSession
    work = Work(spark, "named")
    part = F.substring("entity", 1, NAMED)
    asked = work.write(names.select("entity").distinct().select("entity", part.alias("part")), "asked")
    told = asked.select("part").distinct().mapInArrow(_slots, "n int, bits binary").groupBy("n").applyInArrow(_either, "n int, bits binary").collect()  # NAMED bitmaps at most
    shared = spark.sparkContext.broadcast({r["n"]: bytes(r["bits"]) for r in told})
    kind = dict(texts.dtypes)["name"]
    dealt = texts.where("said IS NOT NULL").select("name", "said").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")  # a table of few files would be the work of as few tasks
    met = dealt.mapInArrow(lambda it: _parts_of(it, shared.value), f"name {kind}, part string").join(asked, "part")
    long = F.length("entity") > NAMED
    if asked.where(long).isEmpty():
        return met.select("name", "entity")
    met = work.write(met, "met")
    held = met.where(long).join(texts, "name").where(F.contains("said", "entity")).select("name", "entity")
    return met.where(~long).select("name", "entity").union(held)


def anchors(memory: dict, windows: DataFrame) -> DataFrame:
    """When the event that an order word names was: (query_id, at) of the newest entry that names it and has a date.

    windows: (query_id, w). An entry's text is looked through once for all names (named_in); of each name the newest entry is kept.
    """
    asked = windows.where("w.intent IN ('before', 'after') AND w.at IS NULL AND w.entity <> ''").select("query_id", "w.intent", F.col("w.entity").alias("entity"))
    e = memory["entries"].where("event_start IS NOT NULL OR event_end IS NOT NULL").select("name", "updated_at", "event_start", "event_end", F.lower(F.concat_ws("\n", "name", "trigger", "content")).alias("said"))
    if "aliases" in memory:
        a = memory["aliases"].groupBy(F.col("entry").alias("name")).agg(F.concat_ws("\n", F.collect_list(F.lower("text"))).alias("more"))
        e = e.join(a, "name", "left").withColumn("said", F.concat_ws("\n", "said", "more"))
    met = named_in(e.select("name", "said"), asked).join(e.drop("said"), "name")
    last = F.max_by(F.struct("event_start", "event_end", "updated_at", "name"), F.struct("updated_at", "name"))
    newest = met.groupBy("entity").agg(last.alias("e")).select("entity", "e.*")
    at = F.when(F.col("intent") == "before", F.coalesce("event_end", "event_start")).otherwise(F.coalesce("event_start", "event_end"))
    return asked.join(newest, "entity").groupBy("query_id").agg(F.max_by(at, F.struct("updated_at", "name")).alias("at"))


def directional(memory: dict, windows: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, name, rank) of events before or after a query's anchor, nearest first.

    Events are numbered once by time; a query's nearest ones are a range of these numbers, found by an as-of union and
    equal numbers, so that each distinct anchor meets `limit` events.
    """
    w = windows.where("w.intent IN ('before', 'after')").join(anchors(memory, windows), "query_id", "left")
    asked = w.select("query_id", "w.intent", F.coalesce(F.col("w.at").cast("timestamp"), "at").alias("at")).where("at IS NOT NULL")
    out = None
    for side, when in (("before", F.coalesce("event_end", "event_start")), ("after", F.coalesce("event_start", "event_end"))):
        events = memory["entries"].select("name", when.cast("timestamp").alias("at")).where("at IS NOT NULL")
        key = F.unix_micros("at") if side == "after" else -F.unix_micros("at")
        # events are numbered by time: within days, after all events of earlier days, of which there are as many as the calendar has
        own = asked.where(F.col("intent") == side).select("query_id", key.alias("key"))
        rows = events.select(key.alias("key"), F.lit(0).alias("anchor"), "name").union(own.select("key", F.lit(1), F.lit(None).cast("string")).distinct()).withColumn("day", F.floor(F.col("key") / 86_400_000_000))
        upto = F.sum(1 - F.col("anchor"))
        days = rows.groupBy("day").agg(upto.alias("n")).select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
        # an anchor comes after the events of its own time: its number is that of the last of them
        nth = upto.over(Window.partitionBy("day").orderBy("key", "anchor", "name").rowsBetween(Window.unboundedPreceding, 0))
        placed = rows.withColumn("nth", nth).join(days, "day").select("key", "anchor", "name", (F.col("nth") + F.col("earlier")).alias("nth"))
        ahead = placed.where("anchor = 1").select(F.col("key").alias("from"), F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("rank"), (F.col("nth") + F.col("rank")).alias("nth"))
        near = ahead.join(placed.where("anchor = 0").select("nth", "name"), "nth")
        near = own.join(near, own["key"] == near["from"]).select("query_id", "name", "rank")
        out = near if out is None else out.union(near)
    return out


def tiered(lists: list[DataFrame]) -> DataFrame:
    """Ranked lists one after the other, each name where it first comes: (query_id, name, rank)."""
    every = None
    for i, one in enumerate(lists):
        rows = one.select("query_id", "name", F.struct(F.lit(i).alias("tier"), F.col("rank").cast("long").alias("rank")).alias("at"))
        every = rows if every is None else every.union(rows)
    first = every.groupBy("query_id", "name").agg(F.min("at").alias("at"))
    return first.select("query_id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank"))


def associative(memory: dict, cues: DataFrame, cosines: Callable[[DataFrame], DataFrame], depth: int = 2, cap: int = R.CLUSTER_CAP) -> DataFrame:
    """(query_id, name, rank): entries of entities that a walk from a query's cues reaches, by cosine, then by score.

    cues: (query_id, entity); cosines: of pairs (query_id, name), gives (query_id, name, cos). Each query walks by itself: the frontier carries its id.
    """
    links = G.mirrored(memory["edges"]).where("weight > 0")
    entities = memory["entities"].select("entry", "entity").distinct()
    df = entities.groupBy("entity").agg(F.count("*").alias("df"))
    level = cues.join(df, "entity").select("query_id", "entity", (1.0 / F.col("df")).alias("score"))
    visited, reached = cues.select("query_id", "entity").distinct(), None
    for _ in range(depth):
        step = level.join(links, level["entity"] == links["src"]).groupBy("query_id", F.col("dst").alias("entity")).agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
        level = step.join(visited, ["query_id", "entity"], "left_anti")
        reached = level if reached is None else reached.union(level)
        visited = visited.union(level.select("query_id", "entity"))
    best = reached.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "entity"))).where(F.col("nth") <= cap)
    scored = best.join(entities, "entity").groupBy("query_id", F.col("entry").alias("name")).agg(F.sum("score").alias("graph"))
    met = scored.join(cosines(scored.select("query_id", "name")), ["query_id", "name"])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cos", 9)), F.desc(F.round("graph", 9)), "name")
    return met.select("query_id", "name", F.row_number().over(order).alias("rank"))


def active(hits: DataFrame, memory: dict) -> DataFrame:
    """Hits of entries with an active atomic fact; any other goes."""
    live = memory["projections"].where("kind = 'atomic_fact' AND state = 'active'").select(F.col("object_key").alias("id"))
    names = memory["entries"].select("name", "id").join(live, "id", "left_semi").select("name")
    return hits.join(names, "name", "left_semi")


def reweighted(hits: DataFrame, memory: dict, windows: DataFrame, tau_days: float, hard: bool) -> DataFrame:
    """Scores times the decay of their event's distance from the query's window; with hard, hits outside it go."""
    e = memory["entries"].select("name", "event_start", "event_end")
    j = hits.join(windows, "query_id", "left").join(e, "name", "left")
    s, x = bounds(F.col("event_start"), F.col("event_end"), F.lit(None).cast("timestamp"))
    low, high = F.col("w.first").cast("timestamp"), F.col("w.last").cast("timestamp") + F.expr("INTERVAL 1 DAY - INTERVAL 1 MICROSECOND")
    if hard:
        j = j.where(F.col("w").isNull() | intersects(s, x, low, high))
    return j.withColumn("score", F.when(F.col("w").isNull(), F.col("score")).otherwise(F.col("score") * decay(s, x, low, high, tau_days))).select(*hits.columns)


def swept(hits: DataFrame, memory: dict, cues: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits of enumerating queries (query_id, k) widened by their entity cluster: the first k / 2, then the cluster, SWEEP_CAP in all.

    hits: (query_id, name, score, rank); cues: (query_id, entity). Returns (query_id, name, score, rank) of those queries that have a cluster.
    """
    links = G.mirrored(memory["edges"])
    near = cues.union(cues.join(links, cues["entity"] == links["src"]).select("query_id", F.col("dst").alias("entity"))).distinct()
    cluster = near.join(memory["entities"].select(F.col("entry").alias("name"), "entity").distinct(), "entity").join(asked.select("query_id"), "query_id", "left_semi").select("query_id", "name").distinct()
    known = hits.select("query_id", "name", "score")
    second = cluster.join(known, ["query_id", "name"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    second = second.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))).where(F.col("rank") <= R.SWEEP_CAP)
    first = hits.join(asked.withColumn("own", F.greatest(F.lit(1), F.floor(F.col("k") / 2))), "query_id").where("rank <= own").select("query_id", "name", "score", "rank").join(cluster.select("query_id").distinct(), "query_id", "left_semi")
    merged = tiered([first, second]).where(F.col("rank") <= R.SWEEP_CAP)
    return merged.join(known, ["query_id", "name"], "left").select("query_id", "name", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")


def neighbours(hits: DataFrame, entities: DataFrame, seeds: int = R.SEEDS, most: int = R.EXPAND) -> DataFrame:
    """Entries that share entities with a query's first hits: (query_id, name, shared, rank), most shared first."""
    e = entities.select("entry", "entity").distinct()
    tokens = hits.where(F.col("rank") <= seeds).select("query_id", F.col("name").alias("entry")).join(e, "entry").select("query_id", "entity").distinct()
    counts = tokens.join(e, "entity").groupBy("query_id", F.col("entry").alias("name")).agg(F.count("*").alias("shared"))
    return R.top(counts, ["query_id"], [F.desc("shared"), "name"], most)


def reranked(hits: DataFrame, memory: dict, q: DataFrame, reranker: Callable) -> DataFrame:
    """Hits re-ordered by a scorer of (query, content) pairs, over the first of them and their neighbours; queries that it leaves out keep their order.

    q: (query_id, text, k), k being what the search returns; it looks at RERANK_POOL hits, or at k where that is more.
    """
    hits = hits.join(q.select("query_id", F.greatest(F.lit(R.RERANK_POOL), "k").alias("pool")), "query_id").where("rank <= pool").drop("pool")
    first = hits.select("query_id", "name")
    wide = first.union(neighbours(hits, memory["entities"]).select("query_id", "name")).distinct()
    given = wide.join(q.select("query_id", "text"), "query_id").join(memory["entries"].select("name", "content"), "name").select("query_id", "text", "name", "content")
    scored = reranker(given).select("query_id", "name", "score")
    kept = hits.select("query_id", "name", "score").join(scored.select("query_id").distinct(), "query_id", "left_anti")
    both = scored.union(kept)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name")))


def search(memory: dict, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """Results of every query: (query_id, rank, name, score, projection_id, cluster_sweep, before, after), best first.

    projection_id is empty for an entry without one. cluster_sweep tells whether the query was widened by its entity cluster, before and after
    how many candidates it had; a blank query has no results.
    """
    # each step is written: later ones read it several times
    work = Work(queries.sparkSession, "search")
    q = work.write(normalised(queries), "queries")
    windows = q.select("query_id", intent.temporal_window(F.col("text"), F.col("now")).alias("w")).where("w IS NOT NULL")
    keyword = keyword_ranks(memory, q)
    if options.temporal:
        timely = q.join(windows, "query_id", "left_semi")
        lists = [keyword, *([alias_ranks(memory["aliases"], timely)] if "aliases" in memory else []), directional(memory, windows)]
        keyword = tiered(lists)
    vectors = R.stored(memory, options.model)
    most = q.agg(F.max(F.greatest(F.lit(100), 10 * F.col("k")))).first()[0] or 100
    cosines = R.semantic(vectors, q.where("vec IS NOT NULL"), limit=int(most))
    order = lambda *c: Window.partitionBy("query_id").orderBy(*c)
    vec = _within(R.top(cosines, ["query_id"], [F.desc(F.round("cos", 9)), "name"], int(most)), q)
    cues = None
    if options.associative or options.sweep:
        cues, counts = R.whole_query_signal(q, memory["entities"])
        cues = work.write(cues, "cues")
    if not options.associative:
        counts = R.entity_signal(q, memory["entities"])
    ent = counts.withColumnRenamed("entry", "name").withColumn("rank", F.row_number().over(order(F.desc("matched"), "name")))
    signals, names = {"bm25": keyword, "vec": vec, "ent": ent}, ["bm25", "vec", "ent"]
    if options.associative:
        signals["assoc"] = _within(associative(memory, cues, lambda pairs: R.pair_cosines(pairs, vectors, q)), q)
        names.append("assoc")
    hits = active(R.fuse(signals, names).select("query_id", "name", "score"), memory)
    if options.temporal:
        hits = reweighted(hits, memory, windows, options.tau_days, options.hard_filter)
    if 0 < options.penalty < 1:
        old = memory["entries"].where("superseded_by IS NOT NULL AND superseded_by <> ''").select("name", F.lit(True).alias("old"))
        free = windows.select("query_id", F.lit(True).alias("free"))
        j = hits.join(old, "name", "left").join(free, "query_id", "left")
        hits = j.withColumn("score", F.when(F.col("old") & F.col("free").isNull(), F.col("score") * options.penalty).otherwise(F.col("score"))).select("query_id", "name", "score")
    hits = work.write(hits.withColumn("rank", F.row_number().over(order(F.desc("score"), "name"))), "hits")
    cut = q.select("query_id", "k")
    wide = None
    if options.sweep:
        asked = q.where(intent.enumerates(F.col("text"))).select("query_id", "k")
        wide = swept(hits, memory, cues, asked)
    out = hits.withColumn("cluster_sweep", F.lit(False))
    if wide is not None:
        out = out.join(wide.select("query_id").distinct(), "query_id", "left_anti").union(wide.withColumn("cluster_sweep", F.lit(True)).select(*out.columns))
    if options.reranker is not None:
        flags = out.groupBy("query_id").agg(F.bool_or("cluster_sweep").alias("cluster_sweep"))
        wanted = q.join(flags, "query_id").select("query_id", "text", F.when(F.col("cluster_sweep"), R.SWEEP_CAP).otherwise(F.col("k")).alias("k"))
        out = reranked(out, memory, wanted, options.reranker).join(flags, "query_id").select(*out.columns)
    out = work.write(out, "out")
    before, after = hits.groupBy("query_id").agg(F.count("*").alias("before")), out.groupBy("query_id").agg(F.count("*").alias("after"))
    out = out.join(cut, "query_id").where(F.col("rank") <= F.when(F.col("cluster_sweep"), R.SWEEP_CAP).otherwise(F.col("k"))).drop("k")
    p = memory["projections"].where("kind = 'atomic_fact'").select(F.col("object_key").alias("id"), F.col("id").alias("projection_id"))
    known = memory["entries"].select("name", "id").join(p, "id", "left").select("name", F.coalesce("projection_id", F.lit("")).alias("projection_id"))
    return out.join(known, "name").join(before, "query_id").join(after, "query_id").select("query_id", "rank", "name", "score", "projection_id", "cluster_sweep", "before", "after")


def search_multi(memory: dict, subqueries: DataFrame, k: int, options: Options = Options()) -> DataFrame:
    """Results of queries that come as sub-queries (query_id, sub_id, text, vec, now): each is searched, their lists fused by rank.

    A query with one sub-query gets just its results. Returns (query_id, rank, name, score, cluster_sweep); an entry was
    swept if some sub-query's list has it so.
    """
    k = k if k > 0 else R.DEFAULT_K
    t = distinct_texts(subqueries).join(subqueries.select("query_id", "sub_id", "vec", "now"), ["query_id", "sub_id"])
    count = t.groupBy("query_id").agg(F.count("*").alias("subs"))
    t = t.join(count, "query_id").withColumn("own", F.struct("query_id", "sub_id"))
    flat = t.select(F.to_json("own").alias("query_id"), "text", "vec", "now", F.when(F.col("subs") == 1, k).otherwise(10 * k).alias("k"))
    found = search(memory, flat, options).join(t.select(F.to_json("own").alias("key"), F.col("query_id").alias("of"), "subs"), F.col("query_id") == F.col("key"))
    fused = found.groupBy("of", "name").agg(F.when(F.max("subs") == 1, F.max("score")).otherwise(F.sum(1.0 / (R.RRF + F.col("rank")))).alias("score"), F.bool_or("cluster_sweep").alias("cluster_sweep"), F.max("subs").alias("subs"), F.min("rank").alias("own"))
    # one list stays as it is, swept or not; fused ones are cut
    place = [F.when(F.col("subs") == 1, F.col("own")), F.desc(F.round("score", 12)), "name"]
    ranked = fused.withColumnRenamed("of", "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*place)))
    return ranked.where((F.col("subs") == 1) | (F.col("rank") <= k)).select("query_id", "rank", "name", "score", "cluster_sweep")


def retry_union(first: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """Half of a first list, then what is new in a second, then the rest of the first: (query_id, name, rank), limit in all."""
    half = (limit + 1) // 2
    fresh = more.join(first.select("query_id", "name"), ["query_id", "name"], "left_anti")
    return tiered([first.where(F.col("rank") <= half), fresh, first.where(F.col("rank") > half)]).where(F.col("rank") <= limit)


