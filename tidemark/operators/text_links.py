"""Links of texts by their n-grams, counted in cells of two blocks: the grams themselves are never sent or written.

A task writes its texts as blocks in the shared folder: compressed texts, and of each set of grams two rows of bits by
hashed slots (slots with a gram, slots with two or more). What two sets share is bounded by the slots that both have,
those that both have twice, and the grams beyond, of the set that has fewer. A cell bounds all pairs of its blocks by
a matrix product over the first bits, those left by the second ones, and compares the rest on the sets of their texts.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import shared_files
from tidemark.operators import neardup
from tidemark.work import Work

ROWS = 2048  # texts of a block, at most
GRAMS = 1 << 21  # grams of a block, about
HELD = 64 << 20  # bytes that a task gathers before it writes blocks
DIMS = 4096  # slots of a matrix product
LEFT = 512  # rows of a cell that are compared at once


def slots_of(grams: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of the slots with a gram and of those with more, of 3 * 2 ** octave slots."""
    x = grams.view(np.uint64) * neardup._SPREAD
    x = (x ^ (x >> np.uint64(31))) * neardup._SPREAD
    at = ((x >> np.uint64(32)) * np.uint64(3) >> np.uint64(32) << np.uint64(octave)) + (x & np.uint64((1 << octave) - 1))
    k = np.bincount(at.astype(np.int64), minlength=3 << octave)
    return np.packbits(k > 0), np.packbits(k > 1)


def octave_of(n: int) -> int:
    return max(3, int(n).bit_length() - 1)


def folded(one: np.ndarray, two: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of as many octaves less."""
    for _ in range(times):
        a, b = (x.reshape(len(x), 3, 2, -1) for x in (one, two))
        both = a[:, :, 0] & a[:, :, 1]
        one, two = (a[:, :, 0] | a[:, :, 1]).reshape(len(one), -1), (b[:, :, 0] | b[:, :, 1] | both).reshape(len(one), -1)
    return one, two


def _ids(column: pa.Array) -> np.ndarray:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _read_ids(raw: np.ndarray) -> pa.ChunkedArray:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all()["id"]


def _write_blocks(batches, folder: str, n: int):
    """Rows (id, side, text) as files; a row (name, side, octave, lo, hi) of each."""
    import uuid

    schema = pa.schema([("name", pa.string()), ("side", pa.string()), ("octave", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
    held: dict[tuple[str, int], list] = {}
    size = 0

    def flush():
        told = []
        for (side, octave), rows in sorted(held.items()):
            rows.sort(key=lambda r: r[1])
            step = max(1, min(ROWS, GRAMS >> octave))
            for at in range(0, len(rows), step):
                ids, sizes, one, two, texts, lengths = zip(*rows[at : at + step])
                name = uuid.uuid4().hex  # of this attempt: its rows name its files
                arrays = {"ids": _ids(pa.array([x[0].as_py() for x in ids], ids[0].type)), "n": np.array(sizes, np.int64), "one": np.stack(one), "two": np.stack(two)}
                arrays |= {"at": np.cumsum([0, *map(len, texts)]), "length": np.array(lengths, np.int64), "texts": np.frombuffer(b"".join(texts), np.uint8)}
                shared_files.write_arrays(f"{folder}/{name}", arrays)
                told.append((name, side, octave, sizes[0], sizes[-1]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), schema)], schema=schema) if told else None

    for batch in batches:
        ids = batch.column(0)
        for k, (side, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            grams = neardup.grams_of(text, n, "none")
            if not len(grams):
                continue
            octave = octave_of(len(grams))
            raw = text.encode("utf-8", "surrogatepass")
            packed = pa.compress(raw, codec="zstd", asbytes=True)
            held.setdefault((side, octave), []).append((ids[k : k + 1], len(grams), *slots_of(grams, octave), packed, len(raw)))
            size += len(packed) + (3 << octave >> 2) + 200
        if size > HELD:
            size = 0
            if (out := flush()) is not None:
                yield out
    if (out := flush()) is not None:
        yield out


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits each row of x shares with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, x.shape[1], DIMS // 8):
        a, b = (np.unpackbits(z[:, at : at + DIMS // 8], axis=1).astype(np.float32) for z in (x, y))
        out += a @ b.T
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1, dtype=np.int64)


class _Sets:
    """The sets of a block's texts, made as they are asked for."""

    def __init__(self, block: dict, n: int):
        self.block, self.n, self.known = block, n, {}

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.known:
            at = self.block["at"]
            raw = pa.decompress(pa.py_buffer(self.block["texts"][at[i] : at[i + 1]]), int(self.block["length"][i]), codec="zstd", asbytes=True)
            self.known[i] = neardup.grams_of(raw.decode("utf-8", "surrogatepass"), self.n, "none")
        return self.known[i]


def shared_counts(i: np.ndarray, j: np.ndarray, x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many codes row i of x shares with row j of y, for pairs in the order of i; mark: a false value for each code."""
    out = np.zeros(len(i), np.int64)
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
    for s, e in zip(starts, [*starts[1:], len(i)]):
        own = x[at_x[i[s]] : at_x[i[s] + 1]]
        mark[own] = True
        first, n = at_y[j[s:e]], at_y[j[s:e] + 1] - at_y[j[s:e]]
        ends = np.cumsum(n)
        seen = np.cumsum(np.append(0, mark[y[np.repeat(first - ends + n, n) + np.arange(ends[-1])]]))
        out[s:e] = seen[ends] - seen[ends - n]
        mark[own] = False
    return out


def _shared(i: np.ndarray, j: np.ndarray, x, y) -> np.ndarray:
    """How many grams the sets x[i] and y[j] share, for pairs in the order of i."""
    left, right = np.unique(i), np.unique(j)
    sets = [x[k] for k in left.tolist()] + [y[k] for k in right.tolist()]
    at = np.cumsum([0, *map(len, sets)])
    codes = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_inverse=True)[1]
    return shared_counts(np.searchsorted(left, i), np.searchsorted(right, j), codes, at, codes, at[len(left) :], np.zeros(len(codes), bool))


def _cell_hits(x: dict, y: dict, octave_x: int, octave_y: int, least: float, n: int, same: bool):
    """For LEFT rows of the left at a time: where they begin, and which rows of both are linked."""
    octave = min(octave_x, octave_y)
    (one_x, two_x), (one_y, two_y) = folded(x["one"], x["two"], octave_x - octave), folded(y["one"], y["two"], octave_y - octave)
    n_x, n_y = x["n"], y["n"]
    more_x, more_y = n_x - _bits(one_x), n_y - _bits(one_y)
    rest_x, rest_y = more_x - _bits(two_x), more_y - _bits(two_y)
    sets_x, sets_y = _Sets(x, n), _Sets(y, n)
    share = least / (1 + least)
    need_x, need_y = share * n_x - 0.25, share * n_y - 0.25  # half a gram for rounding
    a, b, ex, ey = (v.astype(np.float32) for v in (need_x, need_y, more_x, more_y))
    for at in range(0, len(n_x), LEFT):
        to = at + LEFT
        bound = _product(one_x[at:to], one_y)
        i, j = np.nonzero(bound + np.minimum(ex[at:to, None], ey) >= a[at:to, None] + b)
        if same:
            i, j = i[at + i < j], j[at + i < j]
        kept = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 12):
            p, q = at + i[k : k + (1 << 12)], j[k : k + (1 << 12)]
            most = bound[p - at, q] + _bits(two_x[p] & two_y[q]) + np.minimum(rest_x[p], rest_y[q])
            kept[k : k + (1 << 12)] = most >= need_x[p] + need_y[q]
        i, j = i[kept], j[kept]
        if len(i):
            c = _shared(at + i, j, sets_x, sets_y)
            linked = c / (n_x[at + i] + n_y[j] - c) >= least
            i, j = i[linked], j[linked]
        yield at, at + i, j


def _cell_links(x: dict, y: dict, hits, same: bool, kind) -> pa.RecordBatch:
    """The linked texts of a cell: (a, b, links), b one member for all of a's component of the cell, links a's similar texts in it."""
    shift = 0 if same else len(x["n"])
    links, of, chosen = np.zeros(shift + len(y["n"]), np.int64), np.arange(shift + len(y["n"])), np.zeros(shift + len(y["n"]), bool)
    for _, i, j in hits:
        links += np.bincount(i, minlength=len(links)) + np.bincount(shift + j, minlength=len(links))
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for s, e in zip(starts, np.append(starts[1:], len(i)) if len(i) else []):
            roots = of[shift + j[s:e]]
            if (roots != of[i[s]]).any():
                roots = np.unique(np.append(roots, of[i[s]]))
                chosen[roots] = True
                of[chosen[of]] = roots[0]
                chosen[roots] = False
    own = np.flatnonzero(links)
    ids = _read_ids(x["ids"]) if same else pa.chunked_array([*_read_ids(x["ids"]).chunks, *_read_ids(y["ids"]).chunks])
    ids = ids.combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(own)).cast(kind), ids.take(pa.array(of[own])).cast(kind), pa.array(links[own])], names=["a", "b", "links"])


def _cells(batches, folder: str, kind, hits):
    known: OrderedDict[str, dict] = OrderedDict()

    def block(name):
        if name not in known:
            known[name] = shared_files.map_arrays(f"{folder}/{name}")
        known.move_to_end(name)
        while len(known) > 4:
            known.popitem(last=False)
        return known[name]

    for batch in batches:
        for r in batch.to_pylist():
            x, y = block(r["x"]), block(r["y"])
            out = _cell_links(x, y, hits(x, y, r), r["x"] == r["y"], kind)
            if out.num_rows:
                yield out


def cells_of(blocks: DataFrame, least: float, sides: bool) -> DataFrame:
    """The pairs x, y of blocks (name, side, lo, hi and others) with sizes that can be that similar, and each block with itself; with sides, only pairs of different ones."""
    one, two = (blocks.select(*[F.col(c).alias(s if c == "name" else f"{c}_{s}") for c in blocks.columns]) for s in "xy")
    fit = (F.col("hi_x") >= least * F.col("lo_y") - 1e-6) & (F.col("hi_y") >= least * F.col("lo_x") - 1e-6)
    return one.crossJoin(two).where(fit & F.expr("side_x < side_y" if sides else "x <= y"))


def of_cells(cells: DataFrame, folder: str, kind: str, rows: DataFrame, hits) -> DataFrame:
    """(a, b, links) of all cells; hits(x, y, cell) are linked rows of two blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rows.schema["id"].dataType)
    parts = 8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "x", "y").mapInArrow(lambda it: _cells(it, folder, arrow, hits), f"a {kind}, b {kind}, links long")


def text_links(rows: DataFrame, key: str, text: str, n: int, least: float, side: str | None = None, norm=lambda c: c) -> DataFrame:
    """What gram_links tells of the sets of n-grams of texts, after `norm`: (a, b, links); texts of fewer than n characters have no row.

    Texts are dealt by side and length, so that a block holds such of about one size, and are sent once; blocks meet
    where sizes can be that similar, as files. The time stays quadratic; memory and what is written do not. Keys are unique.
    """
    spark = rows.sparkSession
    work = Work(spark, "texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind, folder = dict(rows.dtypes)[key], f"{work.path}/blocks"
    which: Column = F.coalesce(F.col(side).cast("string"), F.lit("")) if side else F.lit("")
    dealt = rows.select(F.col(key).alias("id"), which.alias("side"), F.col(text).alias("text"), F.length(text).alias("chars")).repartitionByRange(parts, "side", "chars", F.xxhash64("id"))
    told = dealt.select("id", "side", norm(F.col("text")).alias("text")).mapInArrow(lambda it: _write_blocks(it, folder, n), "name string, side string, octave int, lo long, hi long")
    cells = cells_of(work.write(told, "told"), least, side is not None)
    out = work.write(of_cells(cells, folder, kind, dealt, lambda x, y, r: _cell_hits(x, y, r["octave_x"], r["octave_y"], least, n, r["x"] == r["y"])), "links")
    work.drop("blocks")
    return out
