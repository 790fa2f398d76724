"""Retrieval over many queries in one plan: keyword, vector and entity signals, fusion, filters, re-weights, quotas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import keywords as K
from tidemark.functions.text import CJK_LETTERS, normal_form, query_tokens
from tidemark.functions.vectors import cosine
from tidemark.operators.keyword_index import KeywordIndex, entry_runs, lengths, postings, token_grams
from tidemark.operators.phrase_scan import best_hits
from tidemark.work import Work

K1, B, FLOOR = 1.2, 0.75, 1e-6  # of BM25
RRF = 60
DEFAULT_K = 8
SWEEP_CAP, CLUSTER_CAP, EXPAND = 120, 200, 25
RERANK_POOL, SEEDS = 50, 10
WORDS = rf"[{CJK_LETTERS}]|[\p{{L}}\p{{Nd}}&&[^{CJK_LETTERS}]]+"


def pool(k: int) -> int:
    return max(100, 10 * k)


def top(df: DataFrame, by: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, with their rank; the planner keeps only k rows of each task and group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def phrases(queries: DataFrame, text: str = "text") -> DataFrame:
    """The distinct phrases of each query that is a match: (query_id, phrase, n_phrases); those below three characters match nothing."""
    asked = queries.where(K.mode(F.col(text)) == "match").select("query_id", K.phrases(F.col(text)).alias("p"))
    return asked.select("query_id", F.explode("p").alias("phrase"), F.size("p").alias("n_phrases"))


def occurrences(text: Column, phrase: Column) -> Column:
    """Overlapping occurrences of a phrase without special characters."""
    return F.regexp_count(text, F.concat(F.lit("(?="), phrase, F.lit(")")))


def bm25(entries: DataFrame, queries: DataFrame, columns: tuple[str, ...] = ("name", "content"), key: str = "name", index: KeywordIndex | None = None, limit: int | None = None) -> DataFrame:
    """Keyword signal: entries that hold all phrases of a query as substrings, with their BM25 score.

    Document length is the number of character trigrams over all columns, a phrase's frequency its overlapping
    occurrences, its document frequency the entries that hold it. A phrase occurs inside a run of word characters only, so
    that it is looked for in the distinct runs of all entries, by its first trigram, and its entries are found by an
    equi-join with their runs. With an index, which is brought up to date first, only changed entries are read
    for their runs; without, postings of all are made and dropped again once the hits are written.

    With a limit the hits hold as many of each query's best at least, by score rounded to nine digits, then name: then
    tasks look all phrases up in whole entries, and neither where a phrase occurs nor the hits beyond the best are sent.
    """
    some = Work(entries.sparkSession, "keywords")
    if index is not None:
        index.update(entries)
    if limit is not None:
        if index is not None:
            runs, sizes = index.runs(), index.entries().select("name", "dl")
        else:
            runs, sizes = some.write(entry_runs(entries, columns, key), "runs"), lengths(entries, columns, key)
        hits = best_hits(runs, sizes, some.write(phrases(queries), "asked"), limit, some, K1, B, FLOOR)
        some.drop("runs")
        return hits
    if index is not None:
        posted, sizes, grams = index.postings, index.entries().select("name", "dl"), index.grams()
    else:
        rows = some.write(postings(entries, columns, key), "postings")
        posted, sizes, grams = lambda tokens: rows.join(tokens, "token"), lengths(entries, columns, key), token_grams(rows.select("token").distinct())
    hits = some.write(phrase_scores(posted, sizes, grams, some.write(phrases(queries), "asked"), some), "hits")
    some.drop("postings")
    return hits


def phrase_scores(posted: Callable[[DataFrame], DataFrame], sizes: DataFrame, grams: DataFrame, asked: DataFrame, work: Work) -> DataFrame:
    """(query_id, name, score) of entries that hold all phrases of a query: asked (query_id, phrase, n_phrases).

    posted: of tokens (token, phrase, k), gives the postings (name, token, n) joined with them. Where each phrase occurs is
    written once; a query meets the entries of its rarest phrase only, and looks for its other phrases in these.
    """
    stats = sizes.agg(F.count("*").cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))
    wanted = asked.where(F.length("phrase") >= K.LEAST).select("phrase").distinct().withColumn("gram", F.substring("phrase", 1, 3))
    # tokens that hold a phrase: by the phrase's first trigram, then as a whole
    held = grams.join(wanted, "gram").where(F.contains("token", "phrase")).select("token", "phrase", occurrences(F.col("token"), F.col("phrase")).alias("k")).distinct()
    found = work.write(posted(work.write(held, "held")).groupBy("name", "phrase").agg(F.sum(F.col("n") * F.col("k")).cast("double").alias("tf")), "found")
    df = found.groupBy("phrase").agg(F.count("*").cast("double").alias("df"))
    known = work.write(asked.join(df, "phrase"), "known")
    rarest = known.groupBy("query_id", "n_phrases").agg(F.count("*").alias("met"), F.min(F.struct("df", "phrase")).alias("x")).where("met = n_phrases").select("query_id", F.col("x.phrase").alias("phrase"))
    met = rarest.join(found.select("name", "phrase"), "phrase").select("query_id", "name").join(known, "query_id").join(found, ["name", "phrase"])
    hits = met.join(sizes, "name").crossJoin(F.broadcast(stats))  # stats: one row
    return hits.groupBy("query_id", "name", "n_phrases").agg(F.sum(bm25_term()).alias("score"), F.count("*").alias("met")).where("met = n_phrases").select("query_id", "name", "score")


def bm25_term() -> Column:
    """The BM25 score of one phrase in one document, of columns n_docs, df, tf, dl and avgdl."""
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    return idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def fragments(entries: DataFrame, queries: DataFrame, limit: int, key: str = "name", columns: tuple[str, ...] = ("name", "trigger", "content")) -> DataFrame:
    """Fall-back signal of queries whose mode is like: entries that hold every fragment in some column, newest first: (query_id, name, rank).

    Such queries have fragments that no index finds: each of them scans the entries.
    """
    asked = queries.where(K.mode(F.col("text")) == "like").select("query_id", F.transform(K.runs(F.col("text")), F.lower).alias("runs"))
    rows = entries.select(F.col(key).alias("name"), "updated_at", F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]).alias("texts"))
    met = rows.join(asked, F.forall("runs", lambda r: F.exists("texts", lambda x: F.contains(x, r))))
    return top(met.select("query_id", "name", "updated_at"), ["query_id"], [F.desc("updated_at"), "name"], limit).select("query_id", "name", "rank")


def like_match(entries: DataFrame, fragments: list[str], columns: tuple[str, ...] = ("name", "trigger", "content")) -> DataFrame:
    """Entries in which each fragment is part of some column, regardless of case."""
    every = F.lit(True)
    for f in fragments:
        some = F.lit(False)
        for c in columns:
            some = some | F.contains(F.lower(c), F.lit(f.lower()))
        every = every & some
    return entries.where(every)


def base_name(name: Column) -> Column:
    """The entry of a stored vector: shadows bear its name and a suffix."""
    return F.regexp_replace(name, "#(query|alias)$", "")


def stored(memory: dict, model: str | None = None) -> DataFrame:
    """The vectors that a search may meet: of the given model, and of an entry with an active atomic fact.

    The owner bears the vector's name or, where that has a shadow's suffix, the name without it; a shadow whose entry is
    not there takes no part. Without a model, vectors of all are taken.
    """
    v = memory["vectors"]
    if model is not None:
        v = v.where(F.col("model") == model)
    live = memory["projections"].where("kind = 'atomic_fact' AND state = 'active'").select(F.col("object_key").alias("id")).distinct()
    entries = memory["entries"].select("name", "id").join(live.withColumn("live", F.lit(True)), "id", "left").groupBy("name").agg(F.max(F.coalesce("live", F.lit(False))).alias("live"))
    named = v.withColumn("base", base_name(F.col("name")))
    plain = named.where("base = name").join(entries.where("live").select("name"), "name", "left_semi")
    of = entries.select(F.col("name").alias("base"), F.col("live").alias("base_live"))
    own = entries.select("name", F.col("live").alias("own_live"))
    shadows = named.where("base <> name").join(of, "base").join(own, "name", "left").where("base_live OR coalesce(own_live, false)")
    return plain.select(*v.columns).unionByName(shadows.select(*v.columns))


def pair_cosines(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, name, cos) of the given pairs of queries and entries that have a vector of their own; shadows don't count."""
    v = vectors.select("name", F.col("vec").cast("array<double>").alias("v"))
    met = pairs.join(v, "name").join(queries.where("vec IS NOT NULL").select("query_id", F.col("vec").cast("array<double>").alias("q")), "query_id")
    cos = F.when(F.size("v") == F.size("q"), cosine(F.col("v"), F.col("q"))).otherwise(0.0)
    return met.groupBy("query_id", "name").agg(F.max(cos).alias("cos"))


def semantic(vectors: DataFrame, queries: DataFrame, key: str = "name", vec: str = "vec", limit: int | None = None) -> DataFrame:
    """Cosine of every stored vector with every query, the best of each base name's shadows: (query_id, name, cos).

    Blocks of vectors meet blocks of queries in matrix products, so that neither side is gathered; with a limit only
    the best names of each query and block are passed on. Vectors of another length than the query's have a cosine of 0.
    """
    base = base_name(F.col(key))
    # all vectors of a name are in one block, which gives their best
    return blocks_cosine(vectors.select(base.alias("name"), F.col(vec).cast("array<double>").alias("v")), queries.select("query_id", F.col("vec").cast("array<double>").alias("v")), limit)


CHUNK = 1 << 22  # products of a cell that are held at once


def matrix(column, dims: int):
    """The vectors of an Arrow column of lists that have that many components, none null: rows and a double matrix."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) == dims))
    cells = at[:-1][rows, None] + np.arange(dims)
    whole = column.values.is_valid().to_numpy(zero_copy_only=False)[cells].all(1) if len(rows) else np.zeros(0, bool)
    return rows[whole], column.values.to_numpy(zero_copy_only=False).astype(np.float64)[cells[whole]]


def sizes(column):
    """The number of components of each vector of an Arrow column, -1 for null."""
    import numpy as np
    import pyarrow.compute as pc

    return np.array(pc.fill_null(pc.list_value_length(column), -1).to_pylist(), int)


def _cells(left: DataFrame, right: DataFrame, cell, schema: str, rows_left: int, rows_right: int) -> DataFrame:
    """cell(a, b) of each block of left (name, v) with each block of right (query_id, v), of about that many rows each."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64()}
    none = pa.table({n: pa.array([], kinds.get(k, pa.string())) for n, k in (c.split(" ") for c in schema.split(", "))})
    parts_l, parts_r = max(1, -(-left.count() // rows_left)), max(1, -(-right.count() // rows_right))
    one = left.withColumn("l", F.pmod(F.xxhash64("name"), F.lit(parts_l)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(parts_r - 1))))
    two = right.withColumn("r", F.pmod(F.xxhash64("query_id"), F.lit(parts_r)).cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(parts_l - 1))))
    return one.groupBy("l", "r").cogroup(two.groupBy("l", "r")).applyInArrow(lambda a, b: cell(a, b) if a.num_rows and b.num_rows else none, schema)


def cosine_shares(left: DataFrame, right: DataFrame, rows: int = 4096) -> DataFrame:
    """Over all left vectors (name, v), the mean and the most of (cosine + 1) / 2, within 0 and 1, of each right one (query_id, v): (query_id, mean, most).

    Each cell of blocks passes on sums, counts and the most of its queries. Vectors of different lengths and those of no length have
    a cosine of 0, null ones and those with null components a share of 0, those with components that are no numbers one of 1.
    """
    import numpy as np
    import pyarrow as pa

    right = right.select("query_id", "v")
    kind = dict(right.dtypes)["query_id"]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        size_a, size_b = sizes(a["v"]), sizes(b["v"])
        total, most = np.zeros(b.num_rows), np.zeros(b.num_rows)
        flat = np.zeros(a.num_rows, bool)  # of no length
        for dims in set(size_a.tolist()) - {-1}:
            at, v = matrix(a["v"], dims)
            flat[at[(v == 0).all(1)]] = True
        for dims in set(size_b.tolist()):
            own = np.flatnonzero(size_b == dims)
            half = flat | ((size_a >= 0) & (size_a != dims)) if dims >= 0 else flat
            total[own], most[own] = half.sum() / 2, half.any() / 2
            if dims < 0:
                continue
            at_q, q = matrix(b["v"], dims)
            at_q, none = own[np.searchsorted(own, at_q)], (q == 0).all(1)
            total[at_q[none]], most[at_q[none]] = a.num_rows / 2, 0.5
            at_q, q = at_q[~none], q[~none]
            at_v, v = matrix(a["v"], dims)
            v = v[~flat[at_v]]
            if not len(v) or not len(q):
                continue
            with np.errstate(invalid="ignore"):
                v, q = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (v, q))
            step = max(1, CHUNK // len(v))
            for i in range(0, len(q), step):
                share = q[i : i + step] @ v.T
                share = np.clip((np.nan_to_num(share, copy=False, nan=1.0) + 1) / 2, 0, 1)
                total[at_q[i : i + step]] += share.sum(1)
                most[at_q[i : i + step]] = np.maximum(most[at_q[i : i + step]], share.max(1))
        return pa.table({"query_id": b["query_id"], "total": total, "most": most, "n": pa.array([a.num_rows] * b.num_rows, pa.int64())})

    cells = _cells(left, right, cell, f"query_id {kind}, total double, most double, n long", rows, rows)
    return cells.groupBy("query_id").agg((F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))


def blocks_cosine(left: DataFrame, right: DataFrame, limit: int | None, rows: int = 4096, above: float | None = None, dot: bool = False, by_name: bool = False) -> DataFrame:
    """(query_id, name, cos) of all pairs of left (name, v) and right (query_id, v), by blocks of about that many rows; with dot, of inner products.

    With a limit only the best names of each query and block are passed on, with `above` only pairs of a cosine above it.
    Names that tie with the last of the best stay: all of them, or the first `limit` of each value where the caller orders ties by_name.
    Blocks of the left grow with it where there is a limit, up to eight times that size.
    """
    import numpy as np
    import pyarrow as pa

    right = right.select("query_id", F.col("v").alias("v"))  # a column of its own, where both sides come from one table
    kind, name = dict(right.dtypes)["query_id"], dict(left.dtypes)["name"]
    more = rows if limit is None else min(8 * rows, max(rows, left.count() // left.sparkSession.sparkContext.defaultParallelism))

    def scaled(column, dims):
        at, got = matrix(column, dims)
        v = np.zeros((len(column), dims))
        v[at] = got
        if dot:
            return v
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def best_of(row):
        best = np.arange(len(row))
        if limit is not None and len(row) > 2 * limit:  # ties with the last stay
            best = np.flatnonzero(row >= np.partition(row, -limit)[-limit] - 1e-9)
            if by_name and len(best) > 4 * limit:  # names are sorted: the first of each value
                order = np.argsort(row[best], kind="stable")
                value = row[best][order]
                start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                best = np.sort(best[order][np.arange(len(value)) - np.repeat(start, np.diff(np.append(start, len(value)))) < limit])
        return best if above is None else best[row[best] > above]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, found, cos = [], [], []
        size = sizes(b["v"])
        # all vectors of a name are in one block: the best of each name first, then the best names
        names, of = np.unique(a["name"].to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(names)))
        for dims in sorted({x for x in size.tolist() if x > 0}):
            own = np.flatnonzero(size == dims)
            of_dims, q = scaled(a["v"], dims)[order].T, scaled(b["v"], dims)
            step = max(1, CHUNK // a.num_rows)
            for at in range(0, len(own), step):
                c = q[own[at : at + step]] @ of_dims
                c = c if len(names) == len(order) else np.maximum.reduceat(c, starts, axis=1)
                for i, row in zip(own[at : at + step], c):
                    best = best_of(row)
                    ids.append(np.full(len(best), i)), found.append(best), cos.append(row[best])
        at, best = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, found))
        named = pa.array(names, a.schema.field("name").type)
        return pa.table({"query_id": b["query_id"].take(pa.array(at)), "name": named.take(pa.array(best)), "cos": pa.array(np.concatenate(cos) if cos else np.zeros(0), pa.float64())})

    return _cells(left, right, cell, f"query_id {kind}, name {name}, cos double", more, rows)


def fuse(signals: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, name, rank), the terms added in the given order."""
    ranked = None
    for s in order:
        one = signals[s].select("query_id", "name", F.lit(s).alias("signal"), "rank")
        ranked = one if ranked is None else ranked.union(one)
    wide = ranked.groupBy("query_id", "name").agg(*[F.min(F.when(F.col("signal") == s, F.col("rank"))).alias(f"r_{s}") for s in order])
    score = F.lit(0.0)
    for s in order:
        score = score + F.coalesce(1.0 / (RRF + F.col(f"r_{s}")), F.lit(0.0))
    return wide.withColumn("score", score)


def fuse_again(fused: DataFrame, depth: int) -> DataFrame:
    """Fusion of the fused lists of sub-queries (query_id, sub_id, name, score)."""
    ranked = top(fused, ["query_id", "sub_id"], [F.desc("score"), "name"], depth)
    return ranked.groupBy("query_id", "name").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))


def with_quota(hits: DataFrame, k: int, quota: int, is_chunk: Column) -> DataFrame:
    """The k best with up to quota places kept for chunks, either kind filling what the other leaves."""
    kind = hits.withColumn("chunk", is_chunk)
    kind = kind.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk").orderBy(F.desc("score"), "name")))
    totals = kind.groupBy("query_id").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("facts"))
    own = F.least(F.col("chunks"), F.lit(quota))
    facts = F.least(F.col("facts"), k - own)
    chunks = F.least(F.col("chunks"), k - facts)
    kept = kind.join(totals, "query_id").where(F.when(F.col("chunk"), F.col("nth") <= chunks).otherwise(F.col("nth") <= facts))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))).select("query_id", "name", "score", "rank")


def penalised(hits: DataFrame, factor: float, superseded: Column, exempt: Column) -> DataFrame:
    """Scores of superseded entries times a factor strictly between 0 and 1, unless the query is exempt."""
    if not 0 < factor < 1:
        return hits
    return hits.withColumn("score", F.when(superseded & ~exempt, F.col("score") * factor).otherwise(F.col("score")))


def entity_counts(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity signal: distinct query tokens (query_id, token) that are entities of an entry."""
    return tokens.distinct().join(entities, tokens["token"] == entities["entity"]).groupBy("query_id", "entry").agg(F.count_distinct("token").alias("matched"))


SUBSET_BITS = 25  # of a bitmap of the subsets that are asked for
EARLY = 16  # one of so many entries, the first ones, fills most pairs of entities


def _subset_slots(hashes):
    """Slots of the bitmap of subsets, by the hashes of their members in order: one row for each subset."""
    import numpy as np

    x = np.zeros(len(hashes), np.uint64)
    for k in range(hashes.shape[1]):
        x = (x ^ hashes[:, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SUBSET_BITS)).astype(np.int64)


def _subsets(batches, key, size, wanted):
    """(key, x0, x1, ...): the subsets of each row's sorted members t, whose hashes are h; with `wanted`, a bitmap, only those that may be in it."""
    import itertools

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        members, at = batch.column("t").values, batch.column("t").offsets.to_numpy().astype(np.int64)
        hashes, counts = np.ascontiguousarray(batch.column("h").values.to_numpy(zero_copy_only=False)), np.diff(at)
        shift = batch.column("h").offsets.to_numpy()[0] - at[0]
        for k in np.unique(counts[counts >= size]).tolist():
            rows, every = np.flatnonzero(counts == k), itertools.combinations(range(k), size)
            while own := list(itertools.islice(every, 1 << 16)):
                own = np.array(own)
                step = max(1, (1 << 18) // len(own))
                for s in range(0, len(rows), step):
                    of = np.repeat(rows[s : s + step], len(own))
                    place = (at[rows[s : s + step], None, None] + own).reshape(-1, size)
                    if wanted is not None:
                        slot = _subset_slots(hashes[place + shift])
                        kept = (wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                        of, place = of[kept], place[kept]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), *[members.take(pa.array(place[:, c])) for c in range(size)]], names=[key, *[f"x{c}" for c in range(size)]])


def _bitmap(subsets: DataFrame, size: int):
    """The bitmap of subsets (x0, x1, ...); the driver gets a row for each of its bytes at most."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            slot = np.unique(_subset_slots(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> 3).astype(np.int32)), pa.array((1 << (slot & 7)).astype(np.int32))], names=["at", "bit"])

    hashed = subsets.select(*[F.xxhash64(f"x{c}").alias(f"h{c}") for c in range(size)])
    found = hashed.mapInArrow(run, "at int, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (SUBSET_BITS - 3), np.uint8)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint8)
    return subsets.sparkSession.sparkContext.broadcast(out)


def entity_best(tokens: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of entity_counts of each query, by matched descending and entry: (query_id, entry, matched, rank).

    Of the entries that share exactly a given set of a query's tokens, the first `limit` that hold this set are enough, as others
    that hold it come before the later ones. So one token, and two, meet their first entries only; for two these are mostly
    among the first entries of all, and later ones are only looked through for pairs that lack some. Three tokens or more are
    rare: entries that hold three of a query's are found by them, of which a task passes on those that may be asked for.
    The work goes with the cubes of an entry's and of a query's entities.
    """
    work = Work(tokens.sparkSession, "entity_best")
    sets = lambda rows, key: rows.groupBy(key).agg(F.sort_array(F.collect_set("token")).alias("t")).withColumn("h", F.transform("t", lambda x: F.xxhash64(x)))
    held = work.write(sets(entities.where("entry IS NOT NULL").select("entry", F.col("entity").alias("token")), "entry"), "held")
    asked = work.write(sets(tokens.select("query_id", "token").where("token IS NOT NULL"), "query_id"), "asked")
    kinds = {"entry": dict(held.dtypes)["entry"], "query_id": dict(asked.dtypes)["query_id"]}

    def subsets(rows, key, size, wanted=None):
        names = ", ".join(f"x{c} string" for c in range(size))
        return rows.select(key, "t", "h").mapInArrow(lambda it: _subsets(it, key, size, wanted and wanted.value), f"{key} {kinds[key]}, {names}")

    first = top(held.select(F.explode("t").alias("token"), "entry"), ["token"], ["entry"], limit, "nth").select("token", "entry")
    one = asked.select("query_id", F.explode("t").alias("token")).join(first, "token").select("query_id", "entry", F.lit(1).cast("long").alias("matched")).distinct()

    pair = ["x0", "x1"]
    pairs = work.write(subsets(asked, "query_id", 2), "pairs")
    cut = held.select(F.percentile_approx("entry", 1 / EARLY)).first()[0] if kinds["entry"] in ("int", "bigint") else None
    early = held if cut is None else held.where(F.col("entry") <= cut)
    best = work.write(top(subsets(early, "entry", 2), pair, ["entry"], limit, "nth").select("entry", *pair), "best")
    if cut is not None:
        full = best.groupBy(*pair).agg(F.count("*").alias("k")).where(F.col("k") >= limit).select(*pair)
        lacking = work.write(pairs.select(*pair).distinct().join(full, pair, "left_anti"), "lacking")
        if not lacking.isEmpty():
            later = subsets(held.where(F.col("entry") > cut), "entry", 2, _bitmap(lacking, 2))
            best = work.write(top(best.union(later), pair, ["entry"], limit, "nth").select("entry", *pair), "filled")
    two = pairs.join(best, pair).select("query_id", "entry", F.lit(2).cast("long").alias("matched")).distinct()

    three = ["x0", "x1", "x2"]
    triples = work.write(subsets(asked, "query_id", 3), "triples")
    found = one.union(two)
    if not triples.isEmpty():
        met = triples.join(subsets(held, "entry", 3, _bitmap(triples, 3)), three).groupBy("query_id", "entry").agg(F.count("*").alias("k"))
        # m tokens have m (m - 1) (m - 2) / 6 subsets of three
        found = found.union(met.select("query_id", "entry", (F.round(F.cbrt(6 * F.col("k"))) + 1).cast("long").alias("matched")))
    best_of = found.groupBy("query_id", "entry").agg(F.max("matched").alias("matched"))
    return top(best_of, ["query_id"], [F.desc("matched"), "entry"], limit)


def entity_signal(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity signal of query texts: distinct query tokens that are entities of an entry: (query_id, entry, matched)."""
    work = Work(queries.sparkSession, "entities")
    tokens = work.write(queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("token")).where("token <> ''").distinct(), "tokens")
    # of the entities, which may be made of all texts, those that are asked for; below a distinct of the caller's, where there is one
    return entity_counts(tokens, entities.join(tokens.select(F.col("token").alias("entity")).distinct(), "entity", "left_semi").select("entry", "entity"))


def whole_query_signal(queries: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that a whole query names, by a token or as a sequence of words: cues (query_id, entity) and counts (query_id, entry, matched).

    entities: (entry, entity, raw). A sequence is looked for among the query's words by its first one.
    """
    padded = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    kinds = entities.select("entity", "raw").distinct()
    run = F.filter(F.regexp_extract_all(normal_form(F.col("raw")), F.lit(WORDS), F.lit(0)), lambda w: w != "")
    kinds = kinds.withColumn("run", run)
    q = queries.select("query_id", normal_form(F.col("text")).alias("t"), query_tokens(F.col("text")).alias("tokens"))
    q = q.withColumn("run", F.regexp_extract_all("t", F.lit(WORDS), F.lit(0)))
    exact = q.select("query_id", F.explode("tokens").alias("entity")).join(kinds.select("entity").distinct(), "entity").select("query_id", "entity")
    first = q.select("query_id", padded(F.col("run")).alias("line"), F.explode(F.array_distinct("run")).alias("first"))
    phrase = first.join(kinds.where(F.size("run") > 0).select("entity", F.col("run")[0].alias("first"), padded(F.col("run")).alias("part")), "first").where(F.contains("line", "part")).select("query_id", "entity")
    cues = exact.union(phrase).distinct()
    counts = cues.join(entities.select("entry", "entity").distinct(), "entity").groupBy("query_id", "entry").agg(F.count("*").alias("matched"))
    return cues, counts
