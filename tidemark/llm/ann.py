"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Rows are dealt to shards by the hash of their id. A shard's distinct vectors form a graph of layers: each layer holds
about one in FANOUT nodes of that below, every node links to near nodes of its layer in diverse directions, and neighbours
lie in flat arrays of fixed width. Layers are built from the top by insertion: the nodes of the layer above come first, then
the others in random order, in portions of a GROWTH-th of what is there, PORTION at most; each portion searches the graph so far
for its neighbours, and those take it among theirs. Once all are there each node searches again. Links are chosen for the inner product: vectors are completed by one
coordinate to equal length, so that the largest inner product is the nearest. A search goes from the top layer's entry down, a
beam in each. Indexes and blocks of queries are files in the shared folder, which the tasks of a search map: a task for
each pair of them; the results of all shards are merged by their exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.shared_files import map_arrays, write_arrays
from tidemark.work import Work

SHARD = 16_384  # vectors of a shard while the cluster has cores for more shards
SHARD_BYTES = 64 << 20  # of the vectors of a shard, in doubles
FANOUT = 16
WIDTH = 32  # links of a node, half of them its own choice
POOL = 64  # nearest nodes found among which links are chosen
CORE = 256  # first nodes of a layer, which are all compared with each other
GROWTH = 4
PORTION = 512  # of nodes inserted at once, at most
BEAM = 192
UPPER_BEAM = 16
STEP = 4  # nodes of a beam expanded at once
QUERIES = 4_096  # of a block


def completed(v: np.ndarray) -> np.ndarray:
    """Vectors of equal length whose first coordinates are the given ones, on the scale of the largest."""
    v = v / np.abs(v).max()
    square = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


def diverse(v: np.ndarray, own: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of candidates of each own vector (nodes, -1: none) up to width: those first that lie nearer to it than to one already
    chosen, then the nearest of the others; nearest first."""
    out = np.full((len(own), width), -1, np.int32)
    for at in range(0, len(own), 256):
        part = near[at : at + 256]
        among = v[np.maximum(part, 0)]
        value = np.where(part >= 0, np.einsum("ad,acd->ac", own[at : at + 256], among, optimize=True), -np.inf)
        order = np.argsort(-value, 1, kind="stable")
        part, value = np.take_along_axis(part, order, 1), np.take_along_axis(value, order, 1)
        among = np.take_along_axis(among, order[:, :, None], 1)
        between = among @ among.transpose(0, 2, 1)
        kept, count = np.zeros(part.shape, bool), np.zeros(len(part), int)
        for j in range(part.shape[1]):
            covered = (kept & (between[:, j, :] > value[:, j, None])).any(1)
            kept[:, j] = ~covered & (count < width) & (part[:, j] >= 0)
            count += kept[:, j]
        for j in range(part.shape[1]):
            more = ~kept[:, j] & (count < width) & (part[:, j] >= 0)
            kept[:, j] |= more
            count += more
        rows, cols = np.nonzero(kept)
        out[at + rows, np.cumsum(kept, 1)[rows, cols] - 1] = part[rows, cols]
    return out


def layer_links(v: np.ndarray, start, width: int, rng) -> np.ndarray:
    """Neighbours of each node of a layer, -1 where there are fewer: its own choice, then the nearest of those that chose it.

    v: the layer's vectors in order of insertion. start: of vectors, nodes of the layer from which to search, once
    that many nodes are there: (how many, function).
    """
    n, half = len(v), width // 2
    links = np.full((n, width), -1, np.int32)
    back = np.full((n, half), -np.inf, np.float32)  # how near those are

    def insert(new: np.ndarray, done: int) -> None:
        """Give the new nodes links among the first done ones, and these links to them."""
        if not len(new):
            return
        at = start[1](v[new]) if start and done >= start[0] else np.tile(np.linspace(0, done - 1, 4).astype(np.int64), (len(new), 1))
        near = _beam(v[:done], links[:done], v[new], at, POOL)
        near[near == new[:, None]] = -1
        chosen = diverse(v, v[new], near, half)
        taken = links[new, half:]
        both = (taken[:, :, None] == chosen[:, None, :]).any(2)  # of a new choice that had chosen the node
        links[new] = np.concatenate([chosen, np.where(both, -1, taken)], 1)
        back[new] = np.where(both, -np.inf, back[new])
        src, dst = np.repeat(new, half), links[new, :half].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        fresh = ~(links[dst] == src[:, None]).any(1)  # each is a link of the other once
        _take(links, back, src[fresh], dst[fresh], np.einsum("ed,ed->e", v[src[fresh]], v[dst[fresh]]), half)

    done = min(n, CORE)
    sims = v[:done] @ v[:done].T
    np.fill_diagonal(sims, -np.inf)
    links[:done, :half] = diverse(v, v[:done], np.argsort(-sims, 1, kind="stable")[:, : min(POOL, done - 1)], half) if done > 1 else -1
    while done < n:
        to = min(n, done + min(PORTION, max(1, done // GROWTH)))
        insert(np.arange(done, to), done)
        done = to
    # once all are there, each looks again for neighbours: the first ones had few to choose from
    for at in range(0, n if n > CORE else 0, PORTION):
        insert(np.arange(at, min(n, at + PORTION)), n)
    return links


def _take(links: np.ndarray, back: np.ndarray, src: np.ndarray, dst: np.ndarray, value: np.ndarray, half: int) -> None:
    """Let the nodes dst take src among the nearest that chose them."""
    if not len(src):
        return
    order = np.lexsort((-value, dst))
    src, dst, value = src[order], dst[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
    nth = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
    some = nth < half
    touched = dst[first]
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(dst))))
    ids = np.concatenate([links[touched, half:], np.full((len(touched), half), -1, np.int32)], 1)
    near = np.concatenate([back[touched], np.full((len(touched), half), -np.inf, np.float32)], 1)
    ids[row[some], half + nth[some]], near[row[some], half + nth[some]] = src[some], value[some]
    best = np.argsort(-near, 1, kind="stable")[:, :half]
    links[touched, half:], back[touched] = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)


class Graph:
    """Layers from the top down: nodes of each in order of insertion, their neighbours as places in that order, and of
    each layer but the last the places of its nodes in the one below, which are its first ones."""

    def __init__(self, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.nodes, self.links = nodes, links

    @staticmethod
    def build(v: np.ndarray, seed: int = 3) -> "Graph":
        rng = np.random.default_rng(seed)
        whole, order = completed(v), rng.permutation(len(v))
        sizes = [len(v)]
        while sizes[0] > 4 * FANOUT:
            sizes.insert(0, max(1, sizes[0] // FANOUT))
        graph = Graph([], [])
        for size in sizes:  # the layers' nodes are the first of one order
            nodes, above = order[:size], Graph(list(graph.nodes), list(graph.links))
            start = (len(above.nodes[-1]), lambda q, g=above: np.maximum(g.places(whole, q, UPPER_BEAM), 0)) if above.nodes else None
            graph.links.append(layer_links(whole[nodes], start, WIDTH, rng))
            graph.nodes.append(nodes)
        return graph

    def places(self, v: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
        """Places in the last layer's order of the nodes of largest inner product with each query, best first; -1: none."""
        start = np.zeros((len(q), 1), np.int64)  # the entry: the first node of all
        for depth, (nodes, links) in enumerate(zip(self.nodes, self.links)):
            last = depth == len(self.nodes) - 1
            held = v[nodes]
            start = np.concatenate([_beam(held, links, q[a : a + 512], start[a : a + 512], beam if last else UPPER_BEAM) for a in range(0, len(q), 512)])
        return start

    def search(self, v: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
        """Nodes of largest inner product with each query, best first; -1 where there are fewer."""
        v, q = (v / np.abs(v).max()).astype(np.float32), (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
        at = self.places(v, q, beam)
        return np.where(at >= 0, self.nodes[-1][np.maximum(at, 0)], -1)


def _beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
    n, m = len(v), len(q)
    rows = np.arange(m)[:, None]
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # where -1 points
    k = min(beam, start.shape[1])
    ids[:, :k] = start[:, :k]
    sims[:, :k] = np.where(start[:, :k] >= 0, np.einsum("qd,qkd->qk", q, v[np.maximum(start[:, :k], 0)]), -np.inf)
    done[:, :k] = start[:, :k] < 0
    for j in range(1, k):  # a node given twice starts once
        twice = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        ids[twice, j], sims[twice, j], done[twice, j] = -1, -np.inf, True
    seen[rows, np.where(ids >= 0, ids, n)] = True
    while True:
        open_ = np.where(done, -np.inf, sims)
        pick = np.argpartition(-open_, STEP - 1, 1)[:, :STEP] if beam > STEP else np.argsort(-open_, 1)[:, :STEP]
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        if not live.any():
            return np.take_along_axis(ids, np.argsort(-sims, 1, kind="stable"), 1)
        at = np.where(live, np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(done, pick, True, 1)
        near = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(m, -1).astype(np.int64)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[rows, np.where(near >= 0, near, n)], -1, near)
        seen[rows, np.where(near >= 0, near, n)] = True
        new = np.where(near >= 0, np.einsum("qd,qkd->qk", q, v[np.maximum(near, 0)], optimize=True), -np.inf)
        ids, sims = np.concatenate([ids, near], 1), np.concatenate([sims, new], 1)
        done = np.concatenate([done, near < 0], 1)
        top = np.argpartition(-sims, beam - 1, 1)[:, :beam]
        ids, sims, done = (np.take_along_axis(x, top, 1) for x in (ids, sims, done))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as array<double>."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(finite & F.exists(v, lambda x: x != 0))


def build_index(rows: DataFrame, shards: int, k: int, folder: str) -> DataFrame:
    """Write a file for each shard: its distinct vectors, the k + 1 least ids of each, and the graph as flat arrays."""

    def build(key, table):
        dim = len(table.column("v")[0])
        ids = table.column("vec_id").to_numpy()
        v = _matrix(table.column("v"), dim)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        _, first, of = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        grouped = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[grouped], np.arange(len(first) + 1))
        held = [ids[grouped[a : min(b, a + k + 1)]] for a, b in zip(bounds[:-1], bounds[1:])]
        v = v[first]
        graph = Graph.build(v)
        layers = {f"nodes{i}": x for i, x in enumerate(graph.nodes)} | {f"links{i}": x for i, x in enumerate(graph.links)}
        counts = np.array([len(x) for x in held], np.int64)
        write_arrays(f"{folder}/shard-{key[0].as_py()}", {"vectors": v, "ids": np.concatenate(held), "counts": counts, **layers})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "nodes": pa.array([len(v)], pa.int64())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, nodes long")


def write_queries(queries: DataFrame, parts: int, folder: str) -> DataFrame:
    """Write a file for each block of queries."""

    def put(key, table):
        dim = len(table.column("v")[0])
        write_arrays(f"{folder}/queries-{key[0].as_py()}", {"ids": table.column("vec_id").to_numpy(), "vectors": _matrix(table.column("v"), dim)})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int64())})

    return queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(put, "part int, n long")


def search_index(index: DataFrame, blocks: DataFrame, folder: str, k: int, beam: int = BEAM) -> DataFrame:
    """The k best of each shard for each query: (query_id, vec_id, score).

    index, blocks: the written shards and blocks of queries, whose pairs are the tasks; only their numbers are moved.
    """

    def search(batches):
        for batch in batches:
            for shard, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from one(map_arrays(f"{folder}/shard-{shard}"), map_arrays(f"{folder}/queries-{part}"))

    def one(held, asked):
        v, ids, counts = held["vectors"], held["ids"], held["counts"]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        layers = sum(x.startswith("nodes") for x in held)
        graph = Graph([held[f"nodes{i}"] for i in range(layers)], [held[f"links{i}"] for i in range(layers)])
        own, q = asked["ids"], asked["vectors"]
        for at in range(0, len(q), 256):
            out = {"query_id": [], "vec_id": [], "score": []}
            for i, nodes in zip(range(at, at + 256), graph.search(v, q[at : at + 256], max(beam, k + 1))):
                nodes = nodes[nodes >= 0]
                score = (v[nodes] * q[i]).sum(1)
                near = np.concatenate([ids[bounds[x] : bounds[x + 1]] for x in nodes])
                value = np.repeat(score, counts[nodes])
                value, near = value[near != own[i]], near[near != own[i]]
                best = np.lexsort((near, -value))[:k]
                out["query_id"] += [own[i]] * len(best)
                out["vec_id"] += near[best].tolist()
                out["score"] += value[best].tolist()
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    pairs = index.select("shard").join(blocks.select("part"))  # numbers of files: one row for each task
    return pairs.repartition("shard", "part").mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """For each row whose id is divisible by `every`, the k other rows of largest inner product found.

    Returns (query_id, rank, vec_id, score): ranks from 1, largest score first, ties to the smaller id; the
    score is exact, in double precision on the vectors as given. Rows without an id and vectors that are
    null, zero or hold null or non-finite components take no part, nor do those whose length differs from
    the usual one. Equal vectors are one node, so that copies never hide others. All candidates are
    returned where there are fewer than k; an empty table gives an empty result. Rows that repeat an
    id are candidates each, in one shard, and one query each, but none is its own neighbour. Other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Work(spark, "ann")
    rows = usable(vectors, id_col, vector_col)
    kinds = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if kinds is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    n, dim = kinds["count"], kinds["dim"]
    rows = rows.where(F.size("v") == dim)
    # as few shards as their size allows, since each query visits all; more only while cores would be idle
    shards = max(1, -(-8 * n * dim // SHARD_BYTES), min(-(-n // shard), spark.sparkContext.defaultParallelism))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    parts = max(1, -(-n // (every * QUERIES)))
    folder = f"{work.path}/files"
    index = work.write(build_index(rows, shards, k, folder), "index")
    blocks = work.write(write_queries(queries, parts, folder), "blocks")
    found = search_index(index, blocks, folder, k, beam)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
