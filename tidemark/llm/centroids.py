"""Centroid clustering of integer vectors: float32 screening with rigorous intervals, exact where they overlap.

A component x becomes floor(64 * x). The squared distance of x to centroid c is |x|^2 - 2 x.c + |c|^2, of which
the first term is the same for all centroids. One float32 matrix product gives all x.c of a batch; rounding its
operands and any order of its sums, fused or not, err by at most gamma * |x| * |c|, where gamma = m u / (1 - m u),
u = 2^-24 and m is the number of components plus 2 (one rounding of each operand, and the sums). So each centroid
has an interval that holds its true score, and only centroids whose interval begins below the least end can be the
nearest. A vector with one such centroid is assigned; for others the distances to those centroids are computed in
exact integers, and the least number wins a tie.

Tasks send one row of exact component sums for each cluster, which Spark adds up; the driver gets k sums and
counts of each round, the model itself, and no vector but the starting ones.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.work import Work

SCALE = 64
SMALL = 1 << 27  # up to here squared distances of a few thousand components fit in 64 bits
LARGEST = (1 << 63) - 1
ROWS = 8192  # vectors of a matrix product


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component: 64-bit integers, or Python integers where some are beyond SMALL."""
    scaled = vectors.astype(np.float64) * SCALE if vectors.dtype != np.float64 else vectors * SCALE
    if not vectors.size or np.abs(scaled).max() < SMALL:
        return np.floor(scaled).astype(np.int64)
    whole = [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in vectors.astype(np.float64).ravel().tolist()]
    return np.array(whole, object).reshape(vectors.shape)


def _norms(rows: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' Euclidean lengths, in double precision."""
    return np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(-1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of each row, least number first, and how many rows needed exact integers."""
    if not len(x):
        return np.empty(0, np.int64), 0
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    m, u = x.shape[1] + 2, 2.0**-24
    gamma = m * u / (1 - m * u)
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
        squares = np.array([float(int(s)) for s in (centroids * centroids).sum(1)])
        score = squares - 2 * dot
        # the float32 product, then three roundings in double precision
        err = 2 * gamma * np.outer(_norms(x), _norms(centroids)) * (1 + 1e-9)
        err += 4 * 2.0**-53 * (squares + 2 * np.abs(dot) + np.abs(score)) + 1e-300
        low, high = score - err, score + err
    unsafe = ~np.isfinite(score).all(1) | ~np.isfinite(err).all(1)
    least = high.min(1, keepdims=True)
    open_ = (low <= least) | unsafe[:, None]
    found = open_.argmax(1)
    doubt = np.flatnonzero(open_.sum(1) > 1)
    if len(doubt):
        at, which = np.nonzero(open_[doubt])
        d = _exact(x[doubt[at]], centroids[which])
        starts = np.searchsorted(at, np.arange(len(doubt)))
        smallest = np.minimum.reduceat(d, starts)
        first = np.flatnonzero(d == smallest[at])  # in ascending number within each row
        rows, place = np.unique(at[first], return_index=True)
        found[doubt[rows]] = which[first[place]]
    return found, len(doubt)


def _kept(batches, size):
    """(ids, vectors) of rows that have exactly `size` finite components."""
    for batch in batches:
        column = batch.column(1)
        rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.asarray(column.value_lengths().fill_null(-1)) == size))
        for k in range(0, len(rows), ROWS):
            part = batch.take(pa.array(rows[k : k + ROWS]))
            flat = part.column(1).flatten()
            values = flat.to_numpy(zero_copy_only=False)  # a null component becomes NaN
            vectors = values.reshape(-1, size)
            good = np.isfinite(vectors.astype(np.float64)).all(1)
            yield part.column(0).filter(pa.array(good)), vectors[good]


def _sums(batches, size, centroids):
    k = len(centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, size), object)
    for _, vectors in _kept(batches, size):
        x = quantised(vectors)
        at, _ = nearest(x, centroids)
        counts += np.bincount(at, minlength=k)
        for j in np.unique(at):
            sums[j] += x[at == j].sum(0).astype(object)  # fewer than 2^36 rows of less than SMALL, or Python integers
    used = np.flatnonzero(counts)
    if len(used):
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array([[str(v) for v in sums[j]] for j in used], pa.list_(pa.string()))], names=["cluster", "n", "sums"]
        )


def _assigned(batches, size, centroids):
    for ids, vectors in _kept(batches, size):
        x = quantised(vectors)
        at, _ = nearest(x, centroids)
        if not len(x):
            continue
        d = _exact(x, centroids[at]) if x.dtype != object and centroids.dtype != object else _exact(x.astype(object), centroids.astype(object)[at])
        if max(d.tolist()) > LARGEST:
            raise OverflowError("a squared distance exceeds 64 bits")
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(at, pa.int32()), pa.array(d.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])


def _integers(rows: list[list[int]], size: int) -> np.ndarray:
    if all(abs(v) < SMALL for r in rows for v in r):
        return np.array(rows, np.int64).reshape(len(rows), size)
    return np.array(rows, object).reshape(len(rows), size)


def starting(vectors: DataFrame, k: int, size: int) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of `1:<vec_id>`, in ascending order of it."""
    usable = (F.size("vec") == size) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where(usable).select(key.alias("key"), "vec").orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    return _integers([quantised(np.array([r["vec"]], np.float64))[0].tolist() for r in first], size)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, size: int = 64, rounds: int = 3) -> DataFrame:
    """Assign vectors to k centroids after a number of rounds of exact integer k-means.

    Returns (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per row of vectors with
    exactly `size` components, none of them null or non-finite; other rows take no part. Rows that repeat an id
    count each for itself; where ids of starting vectors tie, the smaller vector (component by component) goes
    first, and rows without an id start no cluster while others are left. Fewer than k kept rows make fewer
    clusters, an empty table an empty result. Columns beside the two are ignored. Components may be of any size:
    beyond SMALL the arithmetic is in Python's integers. It is an error if a squared distance or a sum of
    them exceeds 64 bits, in which they are returned. The table is read once for each round and twice more;
    ids of a table are taken as they come, so it must give equal rows each time.
    """
    spark = vectors.sparkSession
    work = Work(spark, "centroids")
    kind = dict(vectors.dtypes)[vector_col]
    vec = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    centroids = starting(source, k, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(source, centroids, size)
    c = spark.sparkContext.broadcast(centroids)
    rows = work.write(source.mapInArrow(lambda it: _assigned(it, size, c.value), "vec_id long, cluster int, distance long"), "rows")
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in centroids.tolist()]
    per = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = int(sum(per.values()))
    if total > LARGEST:
        raise OverflowError("the sum of squared distances exceeds 64 bits")
    about = spark.createDataFrame([(j, int(per.get(j, 0)), total, d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each of k centroids


def _moved(source: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """Each centroid as the exact floor of its vectors' mean; those without vectors stay."""
    c = source.sparkSession.sparkContext.broadcast(centroids)
    parts = source.mapInArrow(lambda it: _sums(it, size, c.value), "cluster int, n long, sums array<string>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [[int(v) for v in r] for r in centroids.tolist()]
    for r in added.collect():
        out[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
    return _integers(out, size)
