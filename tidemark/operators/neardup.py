"""Near duplicates by sets of grams and by vectors, in blocks: no pair that may be similar is left out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.work import Work

BLOCK = 4096  # vectors of one side of a comparison


def grams_of(text: str | None, n: int = 3, short: str = "whole") -> np.ndarray:
    """The set of text_grams of one text."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        c = c if short == "whole" else c[:0]
        return np.array([sum((int(x) + 1) << 21 * i for i, x in enumerate(c)) & (2**63 - 1)], np.int64) if len(c) else np.empty(0, np.int64)
    c += np.uint64(1)
    code, high = np.zeros(len(c) - n + 1, np.uint64), np.empty(len(c) - n + 1, np.uint64)
    for i in range(n):
        own = c[i : len(c) - n + 1 + i]
        if n <= 3:
            code += own << np.uint64(21 * i)
        else:
            np.right_shift(code, np.uint64(29), out=high)
            code ^= own
            code *= np.uint64(0x9E3779B97F4A7C15)
            code += high
    code = code.view(np.int64)
    code.sort()  # np.unique takes several times as long
    return code[np.append(True, code[1:] != code[:-1])]


def text_grams(rows: DataFrame, key: str, text: str, n: int = 3, short: str = "whole") -> DataFrame:
    """Sorted distinct n-grams of code points of each text as numbers: (key, grams); n is 3 at most, longer grams are hashed.

    A text of fewer is one gram itself ("whole"), or has none; null is the empty text, which has none.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = [grams_of(t, n, short) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "grams": pa.array(out, pa.list_(pa.int64()))})

    # dealt by key: a table of few files would be the work of as few tasks
    dealt = rows.select(key, text).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.mapInArrow(run, f"`{key}` {kind}, grams array<long>")


SLOTS = 1 << 20  # hashed counters of gram frequencies
SHARE = 64  # a gram of more than 1/SHARE of the sets is frequent
FREQUENT = 4096  # grams apart, at most
ROWS = 4096  # sets of a block: a block is sent to each cell, so that larger ones send less
FILED = 2048  # sets of a block that is a file, at most
MET = 4  # a candidate of a rare gram costs as much as so many pairs of a block
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    x = grams.view(np.uint64) * _SPREAD
    return ((x ^ (x >> np.uint64(31))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


def _counts(batches):
    """Counters of the task's grams by slot, in 64 parts."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            flat = batch.column(0).slice(k, 4096).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(_slot(flat, SLOTS.bit_length() - 1), minlength=SLOTS)
    if total.any():
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(64), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, 64)], pa.binary())})


def _add_counts(key, table):
    total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold a gram of each slot; the counters are of fixed size and added in two steps."""
    told = sets.select("grams").mapInArrow(_counts, "part int, counts binary").withColumn("salt", F.spark_partition_id() % 64)
    added = told.groupBy("part", "salt").applyInArrow(_add_counts, "part int, counts binary").groupBy("part").applyInArrow(_add_counts, "part int, counts binary")
    total = np.zeros((64, SLOTS // 64), np.int64)
    for r in added.collect():
        total[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return total.ravel()


def _often(batches, slots, least):
    """(gram, k) of the task's grams whose slot is frequent."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        gram, k = np.unique(flat[slots[_slot(flat, SLOTS.bit_length() - 1)] > least], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(k, pa.int64())], names=["gram", "k"])


def _frequent(sets: DataFrame, slots: np.ndarray, count: int) -> np.ndarray:
    """The grams of most sets, FREQUENT of them at most, in ascending order."""
    least, shared = max(32, count // SHARE), sets.sparkSession.sparkContext.broadcast(slots)
    counted = sets.select("grams").mapInArrow(lambda it: _often(it, shared.value, least), "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k"))
    return np.sort(np.array([r["gram"] for r in counted.where(F.col("k") > least).orderBy(F.desc("k"), "gram").limit(FREQUENT).collect()], np.int64))


def _encoded(batches, often, slots, least, count):
    """Bits of a set's frequent grams, its other grams from the rarest on, and whether it is compared in blocks.

    It must be where it may be similar by frequent grams alone; it is too where its rare ones would meet more sets than are worth it.
    """
    for batch in batches:
        bits, rest, dense = [], [], []
        for grams in batch.column("grams"):
            g = grams.values.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(often, g), max(0, len(often) - 1))
            hit = often[at] == g if len(often) else np.zeros(len(g), bool)
            row = np.zeros(FREQUENT, bool)
            row[at[hit]] = True
            own = g[~hit]
            often_own = slots[_slot(own, SLOTS.bit_length() - 1)]
            order = np.lexsort((own, often_own))
            own = own[order]
            meets = int((often_own[order[: len(g) - math.ceil(least * len(g) - 1e-9) + 1]] - 1).sum())
            bits.append(np.packbits(row).tobytes()), rest.append(own), dense.append(bool(hit.sum() >= least * len(g) - 1e-9) or meets * MET > count)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("side"), pa.array(bits, pa.binary()), pa.array(rest, pa.list_(pa.int64())), pa.array(dense, pa.bool_())], names=["id", "n", "side", "bits", "rest", "dense"])


def _matrix(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(len(bits), FREQUENT).astype(np.float32)


def _rare_shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each array of the left shares with each of the right: equal ones are found in the right's sorted members."""
    out = np.zeros((len(left), len(right)), np.float32)
    mine = np.concatenate([np.empty(0, np.int64), *left])
    theirs = np.concatenate([np.empty(0, np.int64), *right])
    row = np.repeat(np.arange(len(right)), [len(r) for r in right])
    order = np.argsort(theirs, kind="stable")
    theirs, row = theirs[order], row[order]
    known, of = np.unique(mine, return_inverse=True)
    first, last = np.searchsorted(theirs, known), np.searchsorted(theirs, known, "right")
    at = 0
    for i, own in enumerate(left):
        k = of[at : at + len(own)]
        at += len(own)
        n = last[k] - first[k]
        place = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[i] = np.bincount(row[place], minlength=len(right))
    return out


def _cell_hits(table: pa.Table, least: float):
    """The ids of a cell's two blocks (of one block with itself: twice the same) and, for 256 rows of the left at a time, (place, similarity)."""
    parts = []
    for left in (True, False):
        own = table.filter(pc.equal(table["left"], left)).combine_chunks().sort_by("id")
        rest = [r.values.to_numpy(zero_copy_only=False) for r in own["rest"].combine_chunks()]
        parts.append((own["id"].to_numpy(zero_copy_only=False), own["n"].to_numpy().astype(np.int64), own["bits"].to_pylist(), rest))
    (id_x, n_x, bits_x, rest_x), (id_y, n_y, bits_y, rest_y) = parts

    def run():
        right = _matrix(bits_y) if len(id_x) and len(id_y) else None
        for at in range(0, len(id_x) if len(id_y) else 0, 256):
            to = at + 256
            both = (_matrix(bits_x[at:to]) @ right.T + _rare_shared(rest_x[at:to], rest_y)).astype(np.int64)  # whole numbers below 2^24: exact
            yield at, both / (n_x[at:to, None] + n_y - both)

    return id_x, id_y, run()


def _cell_pairs(table: pa.Table, least: float) -> pa.Table:
    """Similar pairs of a cell: of its two blocks, or of one block with itself."""
    same = table["x"][0].as_py() == table["y"][0].as_py()
    id_x, id_y, chunks = _cell_hits(table, least)
    a, b, sim = [id_x[:0]], [id_x[:0]], [np.empty(0)]
    for at, similarity in chunks:
        i, j = np.nonzero(similarity >= least)
        x, y, s = id_x[at + i], id_y[j], similarity[i, j]
        kept = x < y if same else np.ones(len(x), bool)
        a.append(np.minimum(x, y)[kept]), b.append(np.maximum(x, y)[kept]), sim.append(s[kept])
    kind = table.schema.field("id").type
    return pa.table({"a": pa.array(np.concatenate(a), kind), "b": pa.array(np.concatenate(b), kind), "similarity": pa.array(np.concatenate(sim), pa.float64())})


def _dense_cells(rows: DataFrame, least: float, sides: bool, cell, told_as: str) -> DataFrame:
    """What `cell` tells of sets of mostly frequent grams, in cells of two blocks of sizes that can be that similar."""
    kind = dict(rows.dtypes)["id"]
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int")
    banded = rows.withColumn("band", band)
    blocks = banded.groupBy("band", "side").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))  # a row for each power of 1 / least
    placed = banded.join(blocks, ["band", "side"]).withColumn("own", F.format_string("%08d:%s:%08d", "band", "side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    named = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "side", F.format_string("%08d:%s:%08d", "band", "side", "at").alias("name"))
    other = named.select(F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), F.col("side").alias("s"), F.col("name").alias("y"))
    cells = named.join(other, "band").where("side <> s AND name < y" if sides else "name <= y").select(F.col("name").alias("x"), "y")
    told = ["id", "n", "bits", "rest"]
    one = placed.join(cells, placed["own"] == cells["x"]).select("x", "y", F.lit(True).alias("left"), *told)
    two = placed.join(cells, placed["own"] == cells["y"]).select("x", "y", F.lit(False).alias("left"), *told)
    return one.union(two).groupBy("x", "y").applyInArrow(lambda table: cell(table, least), f"a {kind}, b {kind}, {told_as}")


def _rare_pairs(work: Work, rows: DataFrame, sets: DataFrame, least: float, sides: bool) -> DataFrame:
    """Similar pairs with a set that is not of mostly frequent grams: they share one of the rarest grams of both."""
    length = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    if rows.where("NOT dense").isEmpty():
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).where("false")
    posted = rows.select("id", "n", "side", "dense", F.posexplode(F.slice("rest", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("place", "gram"))
    one, two = (posted.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "side", "dense", "place")]) for s in "xy")
    left = 1 + F.least(F.col("n_x") - F.col("place_x") - 1, F.col("n_y") - F.col("place_y") - 1)
    fit = left * (1 + least) >= least * (F.col("n_x") + F.col("n_y")) - 1e-6
    met = one.where("NOT dense_x").join(two, "gram").where(fit & ((F.col("id_x") < F.col("id_y")) | (F.col("dense_y") & (F.col("id_x") != F.col("id_y")))))
    if sides:
        met = met.where("side_x <> side_y")
    near = work.write(met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), "near")
    near = near.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    same = F.size(F.array_intersect("ga", "gb"))
    return near.withColumn("similarity", same / (F.size("ga") + F.size("gb") - same)).where(F.col("similarity") >= least).select("a", "b", "similarity")


def gram_pairs(rows: DataFrame, key: str, grams: str, least: float, side: str | None = None) -> DataFrame:
    """Pairs of keys with Jaccard similarity of their gram arrays of at least `least`: (a, b, similarity), a < b.

    Grams are numbers or strings, which are hashed. The most frequent grams are set apart. Two similar sets share one of
    the first grams of both, in the order of frequency (of hashed counters; any order gives the same pairs); where that is a
    frequent one, they share frequent grams only, so that both hold mostly such. Such sets are compared in blocks, by size:
    a matrix product counts the frequent grams that all pairs of two blocks share, and a lookup the others. So are sets
    whose rare first grams have together more members than a quarter of all sets. All other
    pairs meet by their rare first grams, with positions and sizes that can still be enough, and are compared whole. So a
    frequent gram gathers no rows in a task; the work is quadratic only in sets that meet most others anyway. With `side`, only
    pairs of different values of that column are compared and returned. Keys are unique; null and empty sets are in no pair.
    """
    work, sets, coded = _coded(rows, key, grams, least, side)
    dense = _dense_cells(coded.where("dense"), least, side is not None, _cell_pairs, "similarity double")
    out = work.write(dense.unionByName(_rare_pairs(work, coded, sets, least, side is not None)), "pairs")
    for name in ("sets", "coded", "near"):
        work.drop(name)
    return out


def gram_links(rows: DataFrame, key: str, grams: str, least: float, side: str | None = None) -> DataFrame:
    """The links of gram_pairs without a row for each pair: (a, b, links).

    A key's links add up over its rows to its number of similar sets, and the edges a, b (a itself, where equal) connect what the pairs connect.
    Of a cell of two blocks there is a row for each linked set; keys without links have no row. Each set is sent once, to its
    block, which cells read as a file (set_links).
    """
    from tidemark.operators.set_links import dense_links

    work, sets, coded = _coded(rows, key, grams, least, side)
    dense = dense_links(work, coded.where("dense"), least, side is not None, min(ROWS, FILED))
    rare = _rare_pairs(work, coded, sets, least, side is not None)
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    rare = rare.select(ends.alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"), F.lit(1).cast("long").alias("links"))
    out = work.write(dense.unionByName(rare), "links")
    for name in ("sets", "coded", "near", "blocks"):
        work.drop(name)
    return out


def link_classes(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """One row for each key of rows by its links (gram_links): (key, component, links); a key without links is alone."""
    from tidemark.operators.components import connected_components

    placed = connected_components(links, "a", "b").select(F.col("node").alias(key), F.col("component").alias("c"))
    counted = links.groupBy(F.col("a").alias(key)).agg(F.sum("links").alias("l"))
    out = rows.select(key).join(placed, key, "left").join(counted, key, "left")
    return out.select(key, F.coalesce("c", key).alias("component"), F.coalesce("l", F.lit(0).cast("long")).alias("links"))


def _coded(rows: DataFrame, key: str, grams: str, least: float, side: str | None) -> tuple[Work, DataFrame, DataFrame]:
    """The written sets (id, side, grams, n), and what _encoded makes of them."""
    spark = rows.sparkSession
    work = Work(spark, "grams")
    g = F.col(grams) if "bigint" in dict(rows.dtypes)[grams] else F.transform(grams, lambda x: F.xxhash64(x))
    which = F.coalesce(F.col(side).cast("string"), F.lit("")) if side else F.lit("")
    sets = work.write(rows.select(F.col(key).alias("id"), which.alias("side"), F.array_sort(F.array_distinct(g)).alias("grams")).where("size(grams) > 0").withColumn("n", F.size("grams")), "sets")
    count, slots = sets.count(), _frequencies(sets)
    often, shared = _frequent(sets, slots, count), spark.sparkContext.broadcast(slots)
    kind = dict(sets.dtypes)["id"]
    coded = sets.mapInArrow(lambda it: _encoded(it, often, shared.value, least, count), f"id {kind}, n int, side string, bits binary, rest array<long>, dense boolean")
    return work, sets, work.write(coded, "coded")


def vector_pairs(rows: DataFrame, key: str, vector: str, least: float, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """All pairs of keys whose vectors have a cosine above `least`: (a, b, cos), a < b.

    Every block of vectors meets every other and itself, by matrix products; no pair is left out. Null
    vectors, and those of no length or of different length, are in no pair where `least` is 0 or more.
    With `within`, only pairs of one value of that column, which is not null, are compared: blocks are of one value.
    """
    group = F.col(within) if within else F.lit(0)
    good = rows.select(F.col(key).cast("long").alias("id"), group.alias("within"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND within IS NOT NULL")
    parts = good.groupBy("within").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = good.join(parts, "within").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = other.select("within", F.least("own", "o").cast("int").alias("x"), F.greatest("own", "o").cast("int").alias("y"), "own", F.size("v").alias("dims"), "id", "v")
    return cells.groupBy("within", "x", "y", "dims").applyInArrow(lambda table: _cell(table, least), "a long, b long, cos double")


def _cell(table: pa.Table, least: float) -> pa.Table:
    """Pairs of one cell: of its two blocks with each other, or of one block with itself."""
    ids = table["id"].to_numpy()
    v = pc.list_flatten(table["v"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    own = table["own"].to_numpy()
    left = own == table["x"][0].as_py()
    right = own == table["y"][0].as_py()
    ids_l, v_l, ids_r, v_r = ids[left], v[left], ids[right], v[right]
    same = table["x"][0].as_py() == table["y"][0].as_py()
    a, b, cos = [], [], []
    for at in range(0, len(ids_l), 512):
        c = v_l[at : at + 512] @ v_r.T
        i, j = np.nonzero(c > least)
        one, two = ids_l[at + i], ids_r[j]
        # within a block each pair is met twice, and each vector meets itself
        k = one < two if same else one != two
        a.append(np.minimum(one, two)[k])
        b.append(np.maximum(one, two)[k])
        cos.append(c[i, j][k])
    none = np.zeros(0)
    return pa.table({"a": np.concatenate([none.astype(np.int64), *a]), "b": np.concatenate([none.astype(np.int64), *b]), "cos": np.concatenate([none, *cos])})
