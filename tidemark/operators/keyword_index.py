"""A kept keyword index: entries' word runs and their trigrams in written generations, of which an update adds one for changed entries only.

A folder holds generations g00000001, g00000002 and so on, each with three tables: entries (name, one, two, dl, gone), what the
generation says of an entry: two hashes of its columns, its length in trigrams, or that it is gone; runs (name, dl, tokens, n) of
its entries, a row for each; grams (gram, token) of their tokens. The newest generation that names an entry holds it. A generation counts once its
entries are written whole, so that an update that dies leaves the index as it was. After MOST generations they are written
as one, which begins with b instead of g and hides all before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import keywords as K
from tidemark.operators.phrase_scan import counted

MOST = 8
ENTRIES, RUNS, GRAMS = "name string, one long, two long, dl double, gone boolean", "name string, dl double, tokens array<string>, n array<long>", "gram string, token string"


def trigrams(columns: tuple[str, ...]) -> Column:
    return sum((F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in columns), F.lit(0)).cast("double")


def lengths(entries: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """(name, dl): the number of character trigrams over all columns."""
    return entries.select(F.col(key).alias("name"), trigrams(columns).alias("dl"))


def postings(entries: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """(name, token, n): how often each run of word characters occurs in an entry, in lower case."""
    runs = F.concat(*[K.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    # dealt by key: a table of few files would be the work of as few tasks
    dealt = entries.select(*{key: 0, **dict.fromkeys(columns)}).repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.select(F.col(key).alias("name"), F.explode(runs).alias("token")).where(F.length("token") >= K.LEAST).groupBy("name", "token").agg(F.count("*").alias("n"))


def entry_runs(entries: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """(name, dl, tokens, n): of each entry its length in trigrams, its distinct runs of word characters in lower case, and how often each occurs."""
    runs = F.concat(*[K.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    # dealt by key: a table of few files would be the work of as few tasks
    dealt = entries.select(*{key: 0, **dict.fromkeys(columns)}).repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    rows = dealt.select(F.col(key).alias("name"), trigrams(columns).alias("dl"), F.filter(runs, lambda r: F.length(r) >= K.LEAST).alias("tokens"))
    return rows.mapInArrow(counted, f"name {dict(rows.dtypes)['name']}, dl double, tokens array<string>, n array<long>")


def posted(runs: DataFrame, *more: str) -> DataFrame:
    """(name, token, n) of entries' runs, and more of their columns."""
    return runs.select("name", *more, F.inline(F.arrays_zip(F.col("tokens").alias("token"), "n")))


def token_grams(tokens: DataFrame) -> DataFrame:
    """(gram, token) of all trigrams of tokens (token)."""
    places = F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.substr("token", i, F.lit(3)))
    return tokens.select(F.explode(F.array_distinct(places)).alias("gram"), "token")


class KeywordIndex:
    """The index of one set of columns of entries with unique names, in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, columns: tuple[str, ...] = ("name", "trigger", "content"), key: str = "name", most: int = MOST):
        self.spark, self.folder, self.columns, self.key, self.most = spark, folder.rstrip("/"), columns, key, most

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def generations(self) -> list[str]:
        """The generations that count, oldest first."""
        fs, path = self._path("")
        names = sorted((s.getPath().getName() for s in fs.listStatus(path)), key=lambda n: n[1:]) if fs.exists(path) else []
        whole = [n for n in names if n[:1] in "gb" and fs.exists(self._path(f"{n}/entries/_SUCCESS")[1])]
        bases = [i for i, n in enumerate(whole) if n[0] == "b"]
        return whole[bases[-1] :] if bases else whole

    def _table(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{g}/{kind}").withColumn("gen", F.lit(int(g[1:]))) for g in self.generations()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, gen int")

    def entries(self) -> DataFrame:
        """(name, one, two, dl, gen) of the entries that are there, and the generation that holds each."""
        held = ["one", "two", "dl", "gone", "gen"]
        if len(self.generations()) == 1:  # nothing is gone or newer
            return self._table("entries", ENTRIES).drop("gone")
        newest = self._table("entries", ENTRIES).groupBy("name").agg(F.max_by(F.struct(*held), "gen").alias("x"))
        return newest.select("name", *[f"x.{c}" for c in held]).where("NOT gone").drop("gone")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(name, token, n) of the entries that are there; with tokens (token, ...) of these alone, joined with their columns."""
        every = posted(self._table("runs", RUNS), "gen")
        met = every if tokens is None else every.join(tokens, "token")
        return self._there(met)

    def runs(self) -> DataFrame:
        """(name, dl, tokens, n) of the entries that are there, a row for each."""
        return self._there(self._table("runs", RUNS))

    def _there(self, rows: DataFrame) -> DataFrame:
        return (rows if len(self.generations()) == 1 else rows.join(self.entries().select("name", "gen"), ["name", "gen"], "left_semi")).drop("gen")

    def grams(self) -> DataFrame:
        """(gram, token) of all generations, where some may repeat, and some be of tokens that no entry has any more."""
        return self._table("grams", GRAMS).select("gram", "token")

    def changes(self, entries: DataFrame) -> DataFrame:
        """(name, one, two, dl, gone) of entries that differ from the index, and of what they lack."""
        said = [x for c in self.columns for x in (F.col(c).isNull(), F.col(c))]
        rows = entries.select(F.col(self.key).alias("name"), F.xxhash64(F.lit(1), *said).alias("one"), F.xxhash64(*said, F.lit(2)).alias("two"), trigrams(self.columns).alias("dl"))
        old = self.entries().select("name", F.col("one").alias("old_one"), F.col("two").alias("old_two"))
        both = rows.join(old, "name", "full_outer").where("NOT (one <=> old_one AND two <=> old_two)")
        return both.select("name", "one", "two", "dl", F.col("one").isNull().alias("gone"))

    def update(self, entries: DataFrame) -> int:
        """Bring the index to the state of entries; the number of entries that changed. Where none has, nothing is written."""
        known = self.generations()
        changed = self.changes(entries)
        if known and changed.isEmpty():
            return 0
        to = f"{self.folder}/g{int(known[-1][1:]) + 1 if known else 1:08d}"
        work = f"{to}/changed"
        changed.write.mode("overwrite").parquet(work)
        changed = self.spark.read.schema(ENTRIES).parquet(work)
        fresh = entries.join(changed.where("NOT gone").select(F.col("name").alias(self.key)), self.key, "left_semi") if known else entries
        self._write(to, changed, entry_runs(fresh, self.columns, self.key))
        count = changed.count()
        if len(known) + 1 > self.most:
            self.compact()
        return count

    def _write(self, to: str, entries: DataFrame, runs: DataFrame) -> None:
        runs.write.mode("overwrite").parquet(f"{to}/runs")
        tokens = self.spark.read.schema(RUNS).parquet(f"{to}/runs").select(F.explode("tokens").alias("token")).distinct()
        token_grams(tokens).write.mode("overwrite").parquet(f"{to}/grams")
        entries.select("name", "one", "two", "dl", "gone").write.mode("overwrite").parquet(f"{to}/entries")  # last: now the generation counts

    def compact(self) -> None:
        """Write what all generations hold as one, and drop them."""
        old = self.generations()
        if len(old) < 2:
            return
        to = f"{self.folder}/b{int(old[-1][1:]) + 1:08d}"
        self._write(to, self.entries().withColumn("gone", F.lit(False)), self.runs())
        for name in old:
            fs, path = self._path(name)
            fs.delete(path, True)
