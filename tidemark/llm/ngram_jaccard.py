"""N-gram Jaccard join: size-aware heavy-light self-join of documents on sets of word shingles.

Two sets of n >= m shingles have Jaccard similarity J >= 4/5 only if they share at least
4(n + m)/9 shingles. Under any one order of all shingles, the first n - ceil(4n/5) + s of the
larger set and the first m - ceil(8m/9) + s of the smaller one then have s shingles in common:

* light sets (at most `boundary` shingles) enumerate the subsets of the fixed size 2 of that prefix (s = 2);
* heavy sets scan the inverted lists of the single shingles of theirs (s = 1); light sets that a
  heavy one may still match are on those lists too.

The boundary is the one of least cost, counted over the sizes of all documents: a subset costs one
posting, an inverted posting costs one and the mean length of the list that it scans. The order is
by document frequency, from counts of all shingles of all documents in SKETCH_BITS hashed
counters, so that passages of many documents come last; any order gives the same result.

Candidates of a list are first compared with a few representatives of their size; only members of
different components found so are then compared with each other. Sets equal in all are one class
from the start. A pair whose histograms of shingle hashes bound its overlap too low is no link; every
other candidate is compared exactly on its full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.operators.components import connected_components
from tidemark.work import Work

WIDTH = 5
SKETCH_BITS = 21
BLOCKS = 256
BLOOM_BITS = 25
MOST_LIGHT = 400
HEADS = (8, 64)  # representatives of a list in each round
_MIX = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = words.word_hashes(texts)
    if len(h) >= width:
        n = len(h) - width + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += h[k : k + n] * (_MIX[k % 5] * np.uint64(2 * (k // 5) + 1))
        rolled = words.mix(rolled)
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i >= width:
            yield np.unique(rolled[i : j - width + 1])
        elif j > i:
            few = np.concatenate([h[i:j] * np.array(_MIX)[np.arange(j - i) % 5], [np.uint64(j - i)]])
            yield words.mix(few.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.empty(0, np.uint64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        pair = np.array([s.sum(dtype=np.uint64), words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
        one, two = words.mix(pair + np.uint64(len(s))).view(np.int64).tolist()
    return one, two


def histogram(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by their leading bits, of 8 to 16 in the mean; a power of two of them."""
    bits = max(0, int(np.log2(max(1, len(s) / 8))))
    at = (s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 65535).astype(np.uint16)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """What two sets can share at most, by their histograms; a full counter bounds nothing."""
    if len(a) > len(b):
        a, b = b, a
    a, b = a.astype(np.int64), b.astype(np.int64)
    a[a == 65535] = b[b == 65535] = 1 << 40
    return int(np.minimum(a, b.reshape(len(a), -1).sum(1)).sum())


def prefixes(n: int) -> tuple[int, int]:
    """Lengths of the probing and of the indexed prefix of a set of n shingles, for s = 1."""
    return n - -(-4 * n // 5) + 1, n - -(-8 * n // 9) + 1


def choose_boundary(sizes: dict[int, int], scanned: float) -> int:
    """The size up to which sets are light. sizes: documents by size up to MOST_LIGHT; scanned: mean list length."""
    best, least = 0, None
    light = {n: k * (p := prefixes(n)[0] + 1) * (p - 1) // 2 for n, k in sizes.items()}
    heavy = {n: k * prefixes(n)[0] * (1 + scanned) for n, k in sizes.items()}
    for b in range(MOST_LIGHT + 1):
        both = sum(k * prefixes(n)[1] for n, k in sizes.items() if 0.8 * (b + 1) <= n <= b)
        cost = sum(light[n] for n in sizes if n <= b) + sum(heavy[n] for n in sizes if n > b) + both
        if least is None or cost < least:
            best, least = b, cost
    return best


def _texts(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return batch.column(0).to_pylist(), words.utf8(batch.column(1))


def _profile(batches, width):
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("hist", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    seen = False
    for batch in batches:
        ids, texts = _texts(batch)
        ns, d1, d2, hist, held = [], [], [], [], []
        for s in shingle_sets(texts, width):
            one, two = digests(s)
            ns.append(len(s)), d1.append(one), d2.append(two), hist.append(histogram(s).tobytes()), held.append(s)
        if held:
            seen = True
            at = (np.concatenate(held) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
            counts += np.bincount(at, minlength=len(counts)).astype(np.uint32)
        k = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(hist, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    if seen:
        for i, part in enumerate(np.split(counts, BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)


def _add_blocks(key, table):
    total = sum(np.frombuffer(x, np.uint64 if len(x) == 8 << SKETCH_BITS >> 8 else np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Of each counter, how far it stands above the mean (0: not); the mean list length of a shingle of level 0."""
    mean = max(1.0, float(counts.mean()))
    level = np.clip(np.floor(4 * np.log2(np.maximum(counts, 1) / mean)), 0, 63).astype(np.uint8)
    low = counts[level == 0].astype(float)
    total = low.sum()
    same = (low**2).sum() - total**2 / max(1, len(low))
    return level, max(0.0, same / max(1.0, total) - 1)


def _prefix_order(s: np.ndarray, level: np.ndarray, length: int) -> np.ndarray:
    rank = level[(s & np.uint64(len(level) - 1)).astype(np.int64)]
    if not rank.any():
        return s[:length]
    return s[np.argsort(rank, kind="stable")[:length]]


def _postings(batches, width, level, boundary):
    """One row per key of each distinct set of the task: (key, cls, n, ub), ub bounding the overlap of a match by that key."""
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("ub", pa.int32())])
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        _, texts = _texts(batch)
        keys, cls, ns, ubs = [], [], [], []
        for s in shingle_sets(texts, width):
            n = len(s)
            if n < 2:  # a set of one shingle matches none but its equal
                continue
            d1, d2 = digests(s)
            if (d1, d2) in seen:
                continue
            seen.add((d1, d2))
            probe, index = prefixes(n)
            order = _prefix_order(s, level, min(n, probe + 1))
            if n <= boundary:
                i, j = np.triu_indices(len(order), 1)
                own = [(words.mix(order[i] * _MIX[0] + order[j] * _MIX[1]), n - j + 1)]
                if n >= 0.8 * (boundary + 1):
                    own.append((order[:index], n - np.arange(index)))
            else:
                own = [(order[:probe], n - np.arange(min(n, probe)))]
            for k, ub in own:
                keys.append(k), ubs.append(ub.astype(np.int32))
                cls.append(np.full(len(k), d1, np.int64)), ns.append(np.full(len(k), n, np.int32))
        if cls:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ubs))], schema=schema)


def _wanted_sets(batches, width, bloom):
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], np.int64)
        h = words.mix(ids.view(np.uint64)) >> np.uint64(64 - BLOOM_BITS)
        hit = np.flatnonzero((bloom[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
        if len(hit):
            taken = batch.take(pa.array(hit))
            sets = list(shingle_sets(words.utf8(taken.column(1)), width))
            yield pa.RecordBatch.from_arrays([taken.column(0).cast(pa.int64()), pa.array([digests(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)


def _bloom_bytes(batches):
    schema = pa.schema([("at", pa.int32()), ("bit", pa.int32())])
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        h = np.unique(words.mix(ids.view(np.uint64)) >> np.uint64(64 - BLOOM_BITS))
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(3)).astype(np.int32)), pa.array((1 << (h & np.uint64(7)).astype(np.int32)).astype(np.int32))], schema=schema)


def _bounded(batches):
    """The pairs that may be linked by their histograms."""
    for batch in batches:
        n, m, x, y = (batch.column(i).to_pylist() for i in range(4, 8))
        kept = [9 * overlap_bound(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) >= 4 * (i + j) for i, j, a, b in zip(n, m, x, y)]
        yield batch.select([0, 1, 2, 3]).filter(pa.array(kept, pa.bool_()))


def _matches(batches):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("linked", pa.bool_())])
    for batch in batches:
        one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        linked, last, s = [], None, None
        for a, b in zip(one, two):
            if a is not last:
                s, last = np.frombuffer(a, np.uint64), a
            t = np.frombuffer(b, np.uint64)
            small, large = (s, t) if len(s) <= len(t) else (t, s)
            at = np.searchsorted(large, small)
            at[at == len(large)] = len(large) - 1
            same = int(np.count_nonzero(large[at] == small))
            linked.append(100 * same >= 80 * (len(s) + len(t) - same))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], schema=schema)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Near-duplicate groups of documents: Jaccard similarity of word shingle sets of 0.8 or more.

    Returns (doc_id, n_shingles, component_id), one row per row of docs. component_id is the smallest
    id that links reach. Null and empty texts have an empty set and link with nothing; a text of fewer
    words than the width is one shingle. Rows that repeat an id are one document with several texts; a
    row without an id is returned with no component, and links with nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "jaccard")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = work.write(source.mapInArrow(lambda it: _profile(it, width), "doc_id long, n long, d1 long, d2 long, hist binary, block int, counts binary"), "profile")
    rows = profile.where("block IS NULL")
    known = rows.select("doc_id", "n", "d1", "d2")
    # the sum of all tasks' counters, in two steps so that no task holds those of all others
    counters = profile.where("block IS NOT NULL").select("block", (F.spark_partition_id() % 64).alias("salt"), "counts")
    added = counters.groupBy("block", "salt").applyInArrow(_add_blocks, "block int, counts binary").groupBy("block").applyInArrow(_add_blocks, "block int, counts binary")
    total = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.uint64)
    for row in added.collect():
        total[row["block"]] = np.frombuffer(row["counts"], np.uint64)
    level, scanned = _levels(total.ravel())
    sizes = {r["n"]: r["k"] for r in known.where(F.col("n").between(2, MOST_LIGHT)).groupBy("n").agg(F.count("*").alias("k")).collect()}
    boundary = choose_boundary(sizes, scanned)

    classes = work.write(rows.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("hist").alias("hist")), "classes")
    shared_level = spark.sparkContext.broadcast(level)
    postings = work.write(source.where("doc_id IS NOT NULL").mapInArrow(lambda it: _postings(it, width, shared_level.value, boundary), "key long, cls long, n int, ub int"), "postings")
    lists = postings.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
    listed = work.write(postings.join(lists, "key").select("key", "cls", "n", "ub").distinct(), "listed")
    work.drop("postings")

    # members of a list with a few representatives of their size, then those of different components with each other
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    digest_of = classes.select(F.col("d1").alias("cls"), "rep", F.col("n").cast("int").alias("n"))
    open_ = listed.withColumn("group", F.lit(None).cast("long"))
    tried, links, grouped = [], None, None
    for step in range(len(HEADS) + 1):
        if step < len(HEADS):
            pairs = _with_heads(work, open_.withColumn("band", band), step)
        else:
            x, y = (open_.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "ub", "group")]) for s in "ab")
            pairs = x.join(y, "key").where("cls_a < cls_b AND group_a <> group_b AND 9 * least(ub_a, ub_b) >= 4 * (n_a + n_b)").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = work.write(pairs, f"pairs{step}")
        tried.append(pairs)
        found = work.write(_compared(work, source, classes, pairs, width, str(step)), f"compared{step}").where("linked").select("src", "dst")
        work.drop(f"sets{step}")
        links = found if links is None else links.union(found)
        grouped = connected_components(links)
        if step == len(HEADS):
            break
        placed = listed.join(digest_of, ["cls", "n"])
        placed = placed.join(grouped, placed["rep"] == grouped["node"], "left").select("key", "cls", "n", "ub", F.coalesce("component", "rep").alias("group"))
        mixed = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
        open_ = work.write(placed.join(mixed, "key").select("key", "cls", "n", "ub", "group"), f"open{step}")
        if open_.isEmpty():
            break

    # copies and links together: a document's component is the least id of its class's component
    member = known.join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep")
    member = member.join(grouped, member["rep"] == grouped["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("class"))
    repeated = member.where("class IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    if repeated.isEmpty():
        return member.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))
    joined = connected_components(member.where("class IS NOT NULL").select(F.col("doc_id").alias("src"), F.col("class").alias("dst")))
    out = member.join(joined.withColumnRenamed("node", "own"), F.col("doc_id") == F.col("own"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))


def _with_heads(work: Work, listed: DataFrame, step: int) -> DataFrame:
    """Pairs of each member of a list and band with some members of it that are not of its component.

    The first round has HEADS[0] representatives, each least in an order of its own. A later one has more, of
    lists with more members than the rounds before had representatives: what is left there are members
    that are linked with few others of a group.
    """
    count = HEADS[step]
    if step:
        large = listed.groupBy("key", "band").agg(F.count("*").alias("k"), F.min("group").alias("lo"), F.max("group").alias("hi")).where((F.col("k") > HEADS[step - 1]) & F.expr("lo < hi"))
        listed = listed.join(large.select("key", "band"), ["key", "band"])
    orders = [F.min(F.struct(F.xxhash64(F.lit(100 * step + i), "cls").alias("h"), "cls", "n", "ub", "group")).alias(f"h{i}") for i in range(count)]
    heads = listed.groupBy("key", "band").agg(F.count("*").alias("k"), *orders).where("k > 1")
    each = F.array_distinct(F.array(*[F.struct(f"h{i}.cls", f"h{i}.n", f"h{i}.ub", f"h{i}.group") for i in range(count)]))
    # a table of its own: the join below shares no exchange with an aggregate, so that a long list can be split
    heads = work.write(heads.select("key", "band", F.explode(each).alias("h")), f"heads{step}")
    met = listed.join(heads, ["key", "band"]).where("h.cls <> cls AND 9 * least(ub, h.ub) >= 4 * (h.n + n) AND coalesce(h.group <> group, true)")
    return met.select(F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b")).distinct()


def _compared(work: Work, source: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, name: str) -> DataFrame:
    """Whether the classes of each pair of digests are linked: (src, dst, linked), by class representatives."""
    spark = source.sparkSession
    d = classes.select("d1", "rep", "n", "hist")
    one, two = (d.select(F.col("d1").alias(s), F.col("rep").alias(r), F.col("n").alias(f"n_{s}"), F.col("hist").alias(f"hist_{s}")) for s, r in (("a", "src"), ("b", "dst")))
    near = pairs.join(one, "a").join(two, "b").where("src <> dst AND 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    near = near.select("a", "b", "src", "dst", "n_a", "n_b", "hist_a", "hist_b").mapInArrow(_bounded, "a long, b long, src long, dst long")
    reps = work.write(near, f"reps{name}")
    ids = reps.select("src").union(reps.select("dst"))
    bits = ids.mapInArrow(_bloom_bytes, "at int, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bloom = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    found = bits.toPandas()
    bloom[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint8)
    shared = spark.sparkContext.broadcast(bloom)
    sets = work.write(source.mapInArrow(lambda it: _wanted_sets(it, width, shared.value), "doc_id long, d1 long, shingles binary"), f"sets{name}").distinct()
    one = sets.select(F.col("doc_id").alias("src"), F.col("d1").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("doc_id").alias("dst"), F.col("d1").alias("b"), F.col("shingles").alias("two"))
    return reps.join(two, ["dst", "b"]).join(one, ["src", "a"]).select("src", "dst", "one", "two").mapInArrow(_matches, "src long, dst long, linked boolean")
