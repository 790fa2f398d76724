"""A memory as an object over written tables: what its commands and tools do, as functions of frames.

Each write reads the current version of a namespace's tables, applies a function of tables and writes the next version whole, then
marks it as current: a reader sees one version or the next. Of two writers that read the same version the second one's mark is refused:
it reads the tables again and repeats its change, so that no write is lost.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import graph as G, lineage as L, search as S, writes as W
from tidemark.sources.files import check_namespace, namespaces

VERSION = "2"
TABLES = {
    "entries": "name string, id string, trigger string, content string, pinned boolean, durability string, category string, hit_count long, created_at timestamp, updated_at timestamp, last_used_at timestamp, event_start timestamp, event_end timestamp, superseded_by string, revision long",
    "vectors": "name string, model string, vec array<float>, at timestamp",
    "entities": "entry string, entity string, raw string",
    "edges": "entity_a string, entity_b string, weight double",
    "aliases": "entry string, text string",
    "projections": "id string, object_key string, state string, kind string",
    "lineage": "projection_id string, evidence_id string, source_order long",
    "evidence": "id string, content string, state string",
}
MOST_CONTENT, MOST_TRIGGER = 1200, 120
TRIES = 5


@dataclass
class Config:
    """Where memories are kept and how they are searched; from arguments, or the environment below them."""

    folder: str
    namespace: str = "default"
    limit: int = 8

    @staticmethod
    def read(arguments: Mapping[str, str], environment: Mapping[str, str] = os.environ) -> "Config":
        find = lambda k, d=None: arguments.get(k) or environment.get(f"TIDEMARK_{k.upper()}") or d
        folder = find("folder")
        if not folder:
            raise ValueError("no folder is given")
        return Config(folder, check_namespace(find("namespace", "default")), int(find("limit", 8)))


class Conflict(RuntimeError):
    """Another writer has committed since the tables were read."""


def retried(f):
    """A write that reads the tables anew and is done again where another writer was first, TRIES times at most."""

    @functools.wraps(f)
    def run(self, *args, **kwargs):
        for k in range(TRIES):
            try:
                return f(self, *args, **kwargs)
            except Conflict:
                if k == TRIES - 1:
                    raise

    return run


class Memory:
    """One namespace, of which several writers may be at work: each commits whole versions, of which none is lost. Frames that are returned read the version that was current when they were made."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.path = f"{config.folder.rstrip('/')}/{check_namespace(config.namespace)}"

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _version(self) -> tuple[int, str]:
        """The last version whose mark is written, and the folder of its tables, which the mark names."""
        fs, found = self._at()
        marks = sorted((int(s.getPath().getName()[5:]) for s in fs.listStatus(found) if s.getPath().getName().startswith("done-")), reverse=True) if fs.exists(found) else []
        for n in marks:
            stream = fs.open(self._at(f"done-{n}")[1])
            try:
                folder = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if folder:
                return n, folder
        return 0, ""

    def tables(self) -> dict[str, DataFrame]:
        self._base, folder = self._version()
        if not folder:
            return {k: self.spark.createDataFrame([], schema) for k, schema in TABLES.items()}
        return {k: self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{k}") for k, schema in TABLES.items()}

    def _write(self, tables: dict[str, DataFrame]) -> None:
        """Commit tables as the version after the one that was read last: all of them, or Conflict where another writer was first."""
        from py4j.protocol import Py4JJavaError

        n = self._base + 1
        folder = f"v{n}-{uuid.uuid4().hex}"
        for k, schema in TABLES.items():
            columns = [c.split(" ")[0] for c in schema.split(", ")]
            tables[k].select(*columns).write.parquet(f"{self.path}/{folder}/{k}")
        fs, mark = self._at(f"done-{n}")
        try:
            stream = fs.create(mark, False)  # the one who makes the mark has the version
        except Py4JJavaError as e:
            fs.delete(self._at(folder)[1], True)
            raise Conflict(f"another writer has committed version {n}") from e
        stream.write(bytearray(folder.encode()))
        stream.close()

    @retried
    def add(self, new: DataFrame, refs: DataFrame | None = None) -> None:
        """Write entries (name, content, at, and any other column of entries), with references to evidence (entry, evidence_id, source_order) where given."""
        long = new.where((F.length("content") > MOST_CONTENT) | (F.length("trigger") > MOST_TRIGGER) | F.col("trigger").rlike(r"[\r\n]")) if "trigger" in new.columns else new.where(F.length("content") > MOST_CONTENT)
        bad = [r["name"] for r in long.select("name").limit(5).collect()]
        if bad:
            raise ValueError(f"content or trigger is over its limit: {bad}")
        t = self.tables()
        kinds = dict(t["entries"].dtypes)
        given = {"id": F.sha2("name", 256).substr(1, 26), "pinned": F.lit(False), "durability": F.lit("volatile"), "category": F.lit("fact"), "trigger": F.lit(""), "hit_count": F.lit(0), "created_at": F.col("at"), "updated_at": F.col("at"), "revision": F.lit(1)}
        rows = new.select(*[(F.col(c) if c in new.columns else given.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds.items()])
        none = self.spark.createDataFrame([], "entry string, evidence_id string, source_order long")
        state, evidence = W.with_sources(t, t["evidence"], rows, refs if refs is not None else none, lambda a, b: _upsert(a, b))
        self._write({**state, "evidence": evidence})

    def get(self, names: list[str]) -> DataFrame:
        return W.by_name(self.tables()["entries"], self.spark.createDataFrame([(n,) for n in names], "name string"))

    def list(self) -> DataFrame:
        return self.tables()["entries"].orderBy("name")

    @retried
    def delete(self, names: list[str]) -> None:
        t = self.tables()
        self._write({**t, **W.delete(t, self.spark.createDataFrame([(n,) for n in names], "name string"))})

    @retried
    def put_vectors(self, new: DataFrame) -> None:
        t = self.tables()
        self._write({**t, "vectors": W.put_vectors(t["vectors"], new, t["entries"], t["projections"])})

    @retried
    def put_entities(self, new: DataFrame) -> None:
        """Replace the entities of some entries: (entry, texts)."""
        t = self.tables()
        listed = W.put_list(t["entities"].select("entry", F.col("entity").alias("key"), F.col("raw").alias("text")), new, W.entity_norm)
        self._write({**t, "entities": listed.select("entry", F.col("key").alias("entity"), F.col("text").alias("raw"))})

    @retried
    def lifecycle(self, ids: list[str], action: str) -> None:
        """tombstone, restore or purge evidence; projections without an active source become stale, purged sources take theirs with them."""
        t = self.tables()
        to = {"tombstone": "tombstoned", "restore": "active", "purge": "purged"}[action]
        legal = [s for (s, a) in L.NEXT if a == action]
        own = self.spark.createDataFrame([(i,) for i in ids], "evidence_id string")
        evidence = t["evidence"].join(own.select(F.col("evidence_id").alias("id"), F.lit(True).alias("hit")), "id", "left")
        evidence = evidence.withColumn("state", F.when(F.col("hit") & F.col("state").isin(*legal), to).otherwise(F.col("state"))).drop("hit")
        p, s = t["projections"], t["lineage"]
        if action == "purge":
            evidence, p, s = L.purge(evidence, p, s, own)
        stale = L.stale_after(p, s, evidence, own).select("id", F.lit(True).alias("stale")) if action != "restore" else None
        if stale is not None:
            p = p.join(stale, "id", "left").withColumn("state", F.when(F.col("stale"), "stale").otherwise(F.col("state"))).drop("stale")
        self._write({**t, "evidence": evidence, "projections": p, "lineage": s})

    def search(self, queries: DataFrame, options: S.Options = S.Options()) -> DataFrame:
        """Results of queries (query_id, text, and vec, now, k where wanted), best first; see search.search."""
        return S.search(self.tables(), _asked(queries, self.config.limit), options)

    def envelope(self, queries: DataFrame, limit: int, options: S.Options = S.Options()) -> DataFrame:
        """One row for each query: (query_id, namespace, limit, returned, degraded), degraded telling of a query without a vector. A limit below 1 is refused."""
        if limit < 1:
            raise ValueError("limit must be positive")
        q = _asked(queries.drop("k") if "k" in queries.columns else queries, limit)
        found = S.search(self.tables(), q, options).groupBy("query_id").agg(F.count("*").alias("returned"))
        return q.join(found, "query_id", "left").select("query_id", F.lit(self.config.namespace).alias("namespace"), F.lit(limit).alias("limit"), F.coalesce("returned", F.lit(0)).alias("returned"), F.col("vec").isNull().alias("degraded"))

    def stats(self) -> DataFrame:
        e = self.tables()["entries"]
        return e.agg(F.count("*").alias("entries"), F.count_if("pinned").alias("pinned"), F.count_if(F.col("category") != "chunk").alias("facts"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))

    def export(self, path: str) -> None:
        from tidemark.sources.files import write_markdown

        write_markdown(self.tables()["entries"].withColumn("ns", F.lit(self.config.namespace)), path)

    @retried
    def ingest(self, turns: DataFrame, extract: Callable[[DataFrame], DataFrame], at) -> None:
        """Turns (id, text) become evidence, and facts of them entries: extract gives (name, content, evidence_id) of the turns that are not blank.

        Facts may have event_start and event_end, entities and aliases (arrays of strings). A fact whose content an entry has already adds
        its sources to it; facts that repeat a similar entry, of no other date, are not written. Entities and aliases of new
        entries are listed, and every two entities of one gain an edge.
        """
        t = self.tables()
        own = turns.where(F.trim("text") != "").select("id", F.col("text").alias("content"), F.lit("active").alias("state")).join(t["evidence"].select("id"), "id", "left_anti")
        facts = extract(turns.where(F.trim("text") != "")).where(F.trim("content") != "")
        facts = facts.join(turns.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
        known = t["entries"].select(F.sha2("content", 256).alias("digest"), F.col("name").alias("owner"))
        known = known.groupBy("digest").agg(F.min("owner").alias("owner"))
        facts = facts.withColumn("digest", F.sha2("content", 256)).join(known, "digest", "left").withColumn("entry", F.coalesce("owner", "name"))
        optional = {"event_start": "timestamp", "event_end": "timestamp", "entities": "array<string>", "aliases": "array<string>"}
        facts = facts.select("name", "content", "evidence_id", "digest", "owner", "entry", *[(F.col(c) if c in facts.columns else F.lit(None)).cast(kind).alias(c) for c, kind in optional.items()])
        new = facts.where("owner IS NULL").groupBy("digest").agg(F.min("name").alias("name"), F.min("content").alias("content"), *[F.min_by(c, "name").alias(c) for c in optional])
        probes = new.select(F.col("name").alias("probe"), "content", F.to_date(F.coalesce("event_start", "event_end")).alias("event_date"))
        again = W.suppressed(probes, t["entries"].withColumn("event_date", F.to_date(F.coalesce("event_start", "event_end")))).select(F.col("probe").alias("name"))
        new = new.join(again, "name", "left_anti")
        kept = facts.join(new.select("digest", F.col("name").alias("as")), "digest", "left").withColumn("entry", F.coalesce("as", "entry"))
        names = t["entries"].select("name").union(new.select("name"))
        refs = kept.join(names.withColumnRenamed("name", "entry"), "entry", "left_semi").select("entry", "evidence_id").distinct()
        old = t["projections"].where("kind = 'atomic_fact'").select(F.col("id").alias("projection_id"), F.col("object_key").alias("id")).join(t["entries"].select("id", F.col("name").alias("entry")), "id").join(t["lineage"], "projection_id").select("entry", "evidence_id", "source_order")
        touched = refs.select("entry").distinct()
        both = old.join(touched, "entry", "left_semi").union(refs.withColumn("source_order", F.lit(1 << 20).cast("long"))).groupBy("entry", "evidence_id").agg(F.min("source_order").alias("source_order"))
        kinds = dict(t["entries"].dtypes)
        given = {"id": F.sha2("name", 256).substr(1, 26), "pinned": F.lit(False), "durability": F.lit("volatile"), "category": F.lit("fact"), "trigger": F.lit(""), "hit_count": F.lit(0), "created_at": at, "updated_at": at, "revision": F.lit(1)}
        rows = new.select(*[(F.col(c) if c in ("name", "content", "event_start", "event_end") else given.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds.items()])
        same = t["entries"].join(touched.withColumnRenamed("entry", "name"), "name", "left_semi")
        state, evidence = W.with_sources({**t}, t["evidence"].union(own), rows.union(same), both, lambda a, b: a.join(rows.select("name"), "name", "left_anti").select(*a.columns).union(rows.select(*a.columns)))
        listed = lambda c: new.where(F.size(c) > 0).select(F.col("name").alias("entry"), F.col(c).alias("texts"))
        put = lambda table, key, text, rows: W.put_list(table.select("entry", key.alias("key"), text.alias("text")), rows, W.entity_norm)
        entities = put(state["entities"], F.col("entity"), F.col("raw"), listed("entities")).select("entry", F.col("key").alias("entity"), F.col("text").alias("raw"))
        aliases = put(state["aliases"], W.entity_norm(F.col("text")), F.col("text"), listed("aliases")).select("entry", "text")
        added = G.co_edges(entities.join(new.select(F.col("name").alias("entry")), "entry", "left_semi"))
        edges = state["edges"].select("entity_a", "entity_b", "weight").union(added).groupBy("entity_a", "entity_b").agg(F.sum("weight").alias("weight"))
        self._write({**state, "evidence": evidence, "entities": entities, "aliases": aliases, "edges": edges})

    @retried
    def curate(self, merges: DataFrame, conflicts: DataFrame, evictions: DataFrame) -> None:
        """Apply a judge's decisions: merges (ns, nth, into, names, ids, revisions, content, at), conflicts with both ends' guards, evictions (name, id, revision), in this order."""
        t = self.tables()
        taken = W.applied_merges(merges, t["entries"])
        state = W.merge(t, taken)
        state["entries"] = W.supersede_unchanged(state["entries"], conflicts)
        gone = taken.select(F.explode("names").alias("name"))
        state = W.delete(state, evictions.join(gone, "name", "left_anti"), guarded=True)
        self._write({**t, **state})

    @retried
    def use(self, uses: DataFrame) -> None:
        """Count uses (name, at)."""
        t = self.tables()
        self._write({**t, "entries": L.bump_usage(t["entries"], uses, "name")})

    @staticmethod
    def namespaces(spark: SparkSession, config: Config) -> list[str]:
        return namespaces(spark, config.folder)


def _asked(queries: DataFrame, limit: int) -> DataFrame:
    given = {"vec": F.lit(None).cast("array<double>"), "now": F.lit(None).cast("date"), "k": F.lit(limit)}
    return queries.select("query_id", "text", *[(F.col(c) if c in queries.columns else x).alias(c) for c, x in given.items()])


def _upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """As lineage.upsert, an old entry keeping its id, and its event bounds where the new ones are null."""
    kept = old.select("name", F.col("id").alias("old_id"), F.col("event_start").alias("s"), F.col("event_end").alias("e"))
    filled = new.join(kept, "name", "left").withColumn("id", F.coalesce("old_id", "id")).withColumn("event_start", F.coalesce("event_start", "s")).withColumn("event_end", F.coalesce("event_end", "e")).select(*new.columns)
    return L.upsert(old, filled, ["name"]).select(*old.columns)
