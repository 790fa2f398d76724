"""Links of sets of mostly frequent grams, counted in cells of two blocks that tasks read as files.

Sets are grouped by size and by kind (which frequent grams they hold). A cell takes the frequent grams in the order of how
much they differ in its two blocks. What two sets share is at most what they share of the first of these and all other grams
of the set that has fewer: a few hundred grams show of nearly all pairs that they are no link. Kinds and the order only save time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import shared_files
from tidemark.operators import text_links
from tidemark.work import Work

LEVELS = (192, 384, 576, 1024, 1 << 30)  # grams that a bound knows of
PAIR = 8192  # a pair that is compared alone costs as much as so many grams of a matrix product
LEFT = 128  # rows of a cell that are compared at once


def _centres(rows: DataFrame, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of some sets' bits, and directions of kinds of sets from there."""
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows.select("bits").limit(2000).collect()]).astype(np.float32)
    mean = x.mean(0)
    x -= mean
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    centre = x[:1]
    while len(centre) < min(kinds, len(x)):
        centre = np.vstack([centre, x[(x @ centre.T).max(1).argmin()]])
    for _ in range(8):
        of = (x @ centre.T).argmax(1)
        centre = np.stack([x[of == k].mean(0) if (of == k).any() else centre[k] for k in range(len(centre))])
        centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-9)
    return mean, centre


def _kinds(batches, mean, centre):
    for batch in batches:
        of = []
        for at in range(0, batch.num_rows, 1024):
            x = np.stack([np.frombuffer(b, np.uint8) for b in batch.column("bits")[at : at + 1024].to_pylist()])
            of.append(((np.unpackbits(x, axis=1) - mean) @ centre.T).argmax(1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *of]), pa.int32())], names=[*batch.schema.names, "kind"])


def _write_block(table: pa.Table, folder: str) -> pa.Table:
    import uuid

    own = table.sort_by([("n", "ascending"), ("id", "ascending")])
    bits = np.stack([np.frombuffer(b, np.uint8) for b in own["bits"].to_pylist()])
    rest = [np.sort(r.values.to_numpy(zero_copy_only=False)) for r in own["rest"].combine_chunks()]
    n, name = own["n"].to_numpy().astype(np.int64), uuid.uuid4().hex
    whole = np.unpackbits(bits, axis=1)
    arrays = {"ids": text_links._ids(own["id"].combine_chunks()), "n": n, "bits": bits, "turned": np.packbits(whole.T, axis=1), "ones": whole.sum(0, dtype=np.int64)}
    arrays |= {"at": np.cumsum([0, *map(len, rest)]), "rest": np.concatenate([np.empty(0, np.int64), *rest])}
    shared_files.write_arrays(f"{folder}/{name}", arrays)
    return pa.table({"name": [name], "side": [own["side"][0].as_py()], "lo": [int(n[0])], "hi": [int(n[-1])]})


class _Side:
    """A block's bits by levels, and how many grams of each set are beyond each."""

    def __init__(self, block: dict, order: np.ndarray, ends: list[int]):
        self.n, self.words, self.turned = block["n"], np.ascontiguousarray(block["bits"]).view(np.uint64), block["turned"]
        self.order, self.ends, self.known = order, ends, []
        self.beyond: list[np.ndarray] = []

    def level(self, k: int) -> np.ndarray:
        """A row for each gram of the level."""
        while len(self.known) <= k:
            own = np.unpackbits(self.turned[self.order[self.ends[len(self.known)] : self.ends[len(self.known) + 1]]], axis=1, count=len(self.n))
            last = self.beyond[-1] if self.beyond else self.n.astype(np.float32)
            self.beyond.append(last - own.sum(0, dtype=np.int32).astype(np.float32))
            self.known.append(own.astype(np.float32))
        return self.known[k]


def _cell_hits(x: dict, y: dict, least: float, same: bool):
    """For LEFT rows of the left at a time: where they begin, and which rows of both are linked."""
    share = (x["ones"] + y["ones"]) / (len(x["n"]) + len(y["n"]))
    order = np.argsort(-share * (1 - share), kind="stable")
    ends = [0, *sorted({min(k, len(order)) for k in LEVELS})]
    one = _Side(x, order, ends)
    two = one if same else _Side(y, order, ends)
    n_x, n_y = one.n, two.n
    rest_x, rest_y = (np.diff(b["at"]) for b in (x, y))
    part = least / (1 + least)
    a, b = ((part * n - 0.25).astype(np.float32) for n in (n_x, n_y))  # half a gram for rounding
    codes: list[np.ndarray] = []

    def shared_rest(i, j):
        if not codes:
            both = np.unique(np.concatenate([x["rest"], y["rest"]]), return_inverse=True)[1]
            codes.extend([both[: len(x["rest"])], both[len(x["rest"]) :], np.zeros(int(both.max(initial=0)) + 1, bool)])
        return text_links.shared_counts(i, j, codes[0], x["at"], codes[1], y["at"], codes[2])

    for at in range(0, len(n_x), LEFT):
        to = min(at + LEFT, len(n_x))
        need = a[at:to, None] + b
        c, more = np.zeros_like(need), np.empty_like(need)
        for k in range(len(ends) - 1):
            c += np.matmul(one.level(k)[:, at:to].T, two.level(k), out=more)
            np.minimum(one.beyond[k][at:to, None], two.beyond[k], out=more)
            more += c
            alive = more >= need
            n = np.count_nonzero(alive)
            if k + 2 == len(ends) or n * PAIR < alive.size * (ends[k + 2] - ends[k + 1]):
                break
        if not n:
            continue
        i, j = np.nonzero(alive)
        if same:
            i, j = i[at + i < j], j[at + i < j]
        if k + 2 == len(ends):
            c = c[i, j].astype(np.int64)
        else:
            c = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(one.words[at + i[s : s + 8192]] & two.words[j[s : s + 8192]]).sum(1, dtype=np.int64) for s in range(0, len(i), 8192)]])
        i = at + i
        most = c + np.minimum(rest_x[i], rest_y[j])
        total = n_x[i] + n_y[j]
        kept = most / (total - most) >= least
        i, j, c, total = i[kept], j[kept], c[kept], total[kept]
        linked = c / (total - c) >= least  # by frequent grams alone
        open_ = np.flatnonzero(~linked)
        if len(open_):
            whole = c[open_] + shared_rest(i[open_], j[open_])
            linked[open_] = whole / (total[open_] - whole) >= least
        yield at, i[linked], j[linked]


def dense_links(work: Work, rows: DataFrame, least: float, sides: bool, block: int) -> DataFrame:
    """Links among coded sets (id, n, side, bits, rest): (a, b, links), a row for each linked set of a cell."""
    folder, kind, count = f"{work.path}/blocks", dict(rows.dtypes)["id"], rows.count()
    steps, kinds = 1 if count < 1 << 14 else 2 if count < 1 << 17 else 4, min(8, count >> 13)
    if kinds > 1:
        mean, centre = _centres(rows, kinds)
        rows = rows.mapInArrow(lambda it: _kinds(it, mean, centre), f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, kind int")
    else:
        rows = rows.withColumn("kind", F.lit(0))
    band = F.floor(steps * F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int")
    rows = rows.withColumn("band", band)
    parts = rows.groupBy("band", "side", "kind").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # a row for each band, side and kind; without a shuffle by these, blocks of one are dealt to different tasks
    placed = rows.join(F.broadcast(parts), ["band", "side", "kind"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    told = placed.groupBy("band", "side", "kind", "part").applyInArrow(lambda table: _write_block(table, folder), "name string, side string, lo long, hi long")
    cells = text_links.cells_of(work.write(told, "told"), least, sides)
    return text_links.of_cells(cells, folder, kind, rows, lambda x, y, r: _cell_hits(x, y, least, r["x"] == r["y"]))
