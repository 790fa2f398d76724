"""Source divergence audit: which sources of a language use its terms differently, in exact integers.

Integer-dictionary encoding. Tasks count the terms of their documents by (lang, source) and send one row for each
term of a group; Spark adds them up with all rows of a (lang, term) in one partition, in UTF-8 order. Each run of
some thousand terms of a language then is one chunk: the sorted array of its kept terms, in which ids of counts are
found by searchsorted, and sparse counts by source number and term id. Ids keep the UTF-8 order, so that a chunk's
counts become dense vectors by one bincount a source, and ties of terms are ties of ids. Totals of groups and
languages are added up from the chunks; the second pass over them makes p of every term, sums f of each pair of sources by
chunk, and takes each source's best terms of each chunk.

No table is broadcast unless Spark finds it small, and nothing but row counts reaches the driver. The vocabulary may be of
any size; what a task holds is a chunk and, of a language with few sources, a matrix of pairs.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import words
from tidemark.work import Work

SALTS = 32
SENT = 1 << 16  # rows of a batch
GRAIN = 1_000_000_000
IN_TERM = np.ones(256, bool)
IN_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


@dataclass(frozen=True)
class Bounds:
    """What a task holds at once."""

    block: int = 1 << 22  # bytes of text that are counted together
    held: int = 1 << 20  # rows of counts
    terms: int = 4096  # terms of a chunk
    rows: int = 1 << 20  # rows of a chunk, except where one term has more
    cells: int = 1 << 20  # cells of a dense block
    pairs: int = 1 << 22  # sums of pairs of sources


def term_array(buf: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The terms of a folded buffer as one Arrow array, and where each starts."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = IN_TERM[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = np.ascontiguousarray(buf[inside[1:-1].view(bool)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), starts


def _parts(text: bytes, block: int):
    """A long text in parts of about `block` bytes, cut between terms."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + block)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


#: Counts by group and term: group numbers, term ids, the dictionary of the ids, documents and occurrences.
Counts = tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]


def _added(group: np.ndarray, ids: np.ndarray, terms: pa.Array, docs: np.ndarray, n: np.ndarray) -> Counts:
    """The same with one row for each term of a group."""
    v = max(1, len(terms))
    key = group * v + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
    return key[first] // v, key[first] % v, terms, add(docs), add(n)


def _block_counts(texts: list[bytes], groups: np.ndarray) -> Counts:
    """Counts of a block of texts."""
    buf = words.FOLD[np.frombuffer(b" ".join(texts), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    terms, starts = term_array(buf)
    coded = terms.dictionary_encode()
    v = max(1, len(coded.dictionary))
    doc = np.searchsorted(offsets, starts, "right") - 1
    key, n = np.unique(doc * v + coded.indices.to_numpy(), return_counts=True)
    return _added(groups[key // v], key % v, coded.dictionary, np.ones(len(key), np.int64), n)


def _merged(held: list[Counts]) -> Counts:
    if len(held) == 1:
        return held[0]
    coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
    at = np.concatenate([[0], np.cumsum([len(h[2]) for h in held])])
    ids = np.concatenate([coded.indices.to_numpy()[x + h[1]] for x, h in zip(at, held)]).astype(np.int64)
    group, docs, n = (np.concatenate([h[i] for h in held]) for i in (0, 3, 4))
    return _added(group, ids, coded.dictionary, docs, n)


def _long_counts(text: bytes, group: int, block: int) -> Counts:
    """Counts of one long text, part by part: each term is of one document."""
    held = None
    for part in _parts(text, block):
        one = _block_counts([part], np.array([group]))
        held = _merged([held, one]) if held else one
    return *held[:3], np.ones(len(held[3]), np.int64), held[4]


def _counted(batches, bounds):
    """(lang, source, term, docs, n) of the task's documents."""
    names: dict[tuple[str, str], int] = {}
    known: list[tuple[str, str]] = []
    held: list[Counts] = []
    size = 0

    def flush():
        nonlocal held, size
        group, ids, terms, docs, n = _merged(held)
        held, size = [], 0
        lang, source = (pa.array([x[i] for x in known], pa.string()) for i in (0, 1))
        for k in range(0, len(group), SENT):
            at, own = pa.array(group[k : k + SENT]), terms.take(pa.array(ids[k : k + SENT]))
            yield pa.RecordBatch.from_arrays(
                [lang.take(at), source.take(at), own.cast(pa.binary()).cast(pa.string()), pa.array(docs[k : k + SENT]), pa.array(n[k : k + SENT], pa.int64())], names=["lang", "source", "term", "docs", "n"]
            )

    for batch in batches:
        lang, source = (["" if x is None else x for x in batch.column(i).to_pylist()] for i in (1, 2))
        texts = words.utf8(batch.column(0))
        group = np.empty(len(texts), np.int64)
        for i, pair in enumerate(zip(lang, source)):
            if pair not in names:
                names[pair] = len(known)
                known.append(pair)
            group[i] = names[pair]
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (to == at or total + len(texts[to]) <= bounds.block):
                total += len(texts[to])
                to += 1
            counts = _long_counts(texts[at], int(group[at]), bounds.block) if total > bounds.block else _block_counts(texts[at:to], group[at:to])
            held.append(counts)
            size += len(counts[0])
            if size > bounds.held:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > bounds.held // 2:
                    yield from flush()
            at = to
        if len(known) > bounds.held and held:
            yield from flush()
            names, known = {}, []
    if held:
        yield from flush()


_CHUNK = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("src", pa.list_(pa.int32())), ("id", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])


def _chunk(rows: pa.Table, least: int) -> pa.RecordBatch | None:
    """One chunk of sorted rows (lang, source, term, docs, n) of one language, with whole terms: its kept terms and sparse counts."""
    term = rows["term"].combine_chunks()
    new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    docs, n = rows["docs"].to_numpy(), rows["n"].to_numpy()
    kept = np.flatnonzero(np.add.reduceat(docs, first) >= least)  # sorted: terms come in UTF-8 order
    if not len(kept):
        return None
    ids = np.minimum(np.searchsorted(kept, run), len(kept) - 1)
    inside = kept[ids] == run
    coded = rows["source"].combine_chunks().filter(pa.array(inside)).dictionary_encode()
    src, ids, n = coded.indices.to_numpy().astype(np.int32), ids[inside].astype(np.int32), n[inside]
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, src, n)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([rows["lang"][0].as_py()], pa.string()), one(term.take(pa.array(first[kept])).to_pylist(), pa.string()), one(coded.dictionary.to_pylist(), pa.string()),
         one(src, pa.int32()), one(ids, pa.int32()), one(n, pa.int64()), one(sums, pa.int64())], schema=_CHUNK)


def _chunks(batches, least, bounds):
    """Chunks of rows sorted by language and term."""
    held: list[pa.Table] = []
    terms = size = 0

    def cut():
        nonlocal held, terms, size
        rows = pa.concat_tables(held).combine_chunks() if held else ()
        made = _chunk(rows, least) if len(rows) else None
        held, terms, size = [], 0, 0
        return [made] if made is not None else []

    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
        other = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], other | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
        here = (lang[0].as_py(), term[0].as_py())
        new[0], turned = here != last, last is not None and here[0] != last[0]
        starts = np.flatnonzero(new)  # where a term begins
        turns = np.concatenate([[0] if turned else [], np.flatnonzero(other) + 1]).astype(np.int64)  # where a language begins
        at = k = 0  # rows and starts that are taken
        while True:
            full = starts[max(k + bounds.terms - terms, 0) :][:1]
            heavy = starts[np.searchsorted(starts, max(at, at + bounds.rows - size)) :][:1]
            turn = turns[np.searchsorted(turns, at, "right" if at or not turned else "left") :][:1]
            to = np.concatenate([full, heavy, turn])
            if not len(to):
                break
            to = int(to.min())
            held.append(rows.slice(at, to - at))
            yield from cut()
            turned, at, k = False, to, int(np.searchsorted(starts, to))
        held.append(rows.slice(at))
        terms, size = terms + len(starts) - k, size + len(rows) - at
        last = (lang[-1].as_py(), term[-1].as_py())
    yield from cut()


def smoothed(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(GRAIN * counts / total), exact for 0 <= counts <= total < 2^53."""
    whole, rest = np.divmod(counts.astype(np.int64), total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def likeness(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of integers of at most GRAIN + 1."""
    return (p - q) ** 2 // (p + q)


def _scored(batches, top, bounds):
    """Partial sums of f by pair of sources, and the best terms of each source, of chunks joined with their language."""
    matrix: dict[str, tuple[list[str], np.ndarray]] = {}
    best: dict[tuple[str, str], list] = {}

    def rows(of):
        if of:
            lang, source, part, item, value = zip(*of)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (lang, source, part, item)] + [pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def told():
        out = [(lang, s, "pair", o, int(m[i, j])) for lang, (names, m) in matrix.items() for i, s in enumerate(names) for j, o in enumerate(names) if i != j]
        out += [(*key, "term", item, value) for key, of in best.items() for value, item in of]
        matrix.clear(), best.clear()
        for k in range(0, len(out), 1 << 16):
            yield from rows(out[k : k + (1 << 16)])

    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name, k=k, batch=batch: batch.column(name)[k]
            lang, terms, names, v = (get(x).as_py() for x in ("lang", "terms", "all_sources", "v"))
            src, ids, n, totals = (get(x).values.to_numpy().astype(np.int64) for x in ("src", "id", "n", "all_n"))
            c = len(terms)
            place = {s: i for i, s in enumerate(names)}
            src = np.array([place[s] for s in get("sources").as_py()], np.int64)[src]
            order = np.argsort(src, kind="stable")
            src, ids, n, totals = src[order], ids[order], n[order], totals + 2 * v

            def dense(lo, hi, src=src, ids=ids, n=n, totals=totals, c=c):
                a, b = np.searchsorted(src, [lo, hi])
                count = np.zeros((hi - lo, c), np.int64)
                count[src[a:b] - lo, ids[a:b]] = n[a:b]
                return smoothed(count + 2, totals[lo:hi, None])

            whole = np.zeros(c, np.int64)
            np.add.at(whole, ids, n)
            q = smoothed(whole + 2, int(totals.sum()) - 2 * v * (len(totals) - 1))
            p = smoothed(n + 2, totals[src])
            f = likeness(p, q[ids])
            ends = np.searchsorted(src, np.arange(len(names) + 1))
            for i, s in enumerate(names):
                a, b = ends[i], ends[i + 1]
                over = np.flatnonzero(p[a:b] > q[ids[a:b]]) + a
                over = over[np.lexsort((ids[over], -f[over]))[:top]]
                if len(over):
                    mine = [(int(f[x]), terms[ids[x]]) for x in over] + best.get((lang, s), [])
                    best[lang, s] = heapq.nsmallest(top, mine, key=lambda z: (-z[0], z[1]))
            step = max(1, bounds.cells // c)
            hold = len(names) ** 2 <= bounds.pairs
            if hold and lang not in matrix:
                if sum(m.size for _, m in matrix.values()) + len(names) ** 2 > bounds.pairs:
                    yield from told()
                matrix[lang] = (names, np.zeros((len(names), len(names)), np.int64))
            for lo in range(0, len(names), step):
                mine = dense(lo, min(len(names), lo + step))
                for other in range(lo, len(names), step):
                    theirs = mine if other == lo else dense(other, min(len(names), other + step))
                    for i in range(len(mine)):
                        sums = likeness(theirs, mine[i]).sum(1)
                        if hold:
                            m = matrix[lang][1]
                            m[lo + i, other : other + len(sums)] += sums
                            if other > lo:
                                m[other : other + len(sums), lo + i] += sums
                        else:
                            yield from rows([(lang, names[lo + i], "pair", names[other + j], int(x)) for j, x in enumerate(sums) if other + j != lo + i])
                            if other > lo:
                                yield from rows([(lang, names[other + j], "pair", names[lo + i], int(x)) for j, x in enumerate(sums)])
            if len(best) > bounds.held // top:
                yield from told()
    yield from told()


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, top: int = 10, bounds: Bounds = Bounds()) -> DataFrame:
    """How each source of a language differs from its other sources, and in which terms from the language.

    Returns (lang, source, part, item, value, rank). Part `pair` has a row for each other source of the language, part
    `term` the `top` terms that the source uses more than the language. Ranks go from 1 by value descending, then by the
    item's UTF-8 bytes. Null text, lang and source are ''. Repeated rows are documents of their own, a text of any
    length is counted whole, and a document is counted once for each of its terms. A language without kept terms
    has pairs of value 0 and no terms, a language of one source no pairs; an empty table gives an empty result. Other columns are
    ignored. The work of part `pair` is sources^2 x kept terms for each language, as its values need; groups and terms of
    2^53 occurrences are beyond its integers.
    """
    spark = docs.sparkSession
    work = Work(spark, "divergence")
    source = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counted = source.mapInArrow(lambda it: _counted(it, bounds), "lang string, source string, term string, docs long, n long")
    # all rows of a term in one partition, where they add up as they come: a task sends one row of each group
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    ordered = counts.sortWithinPartitions("lang", "term")
    made = "lang string, terms array<string>, sources array<string>, src array<int>, id array<int>, n array<long>, sums array<long>"
    chunks = work.write(ordered.mapInArrow(lambda it: _chunks(it, least, bounds), made), "chunks")

    every = source.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(F.lit(0).cast("long").alias("n"))
    own = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.sums").alias("n"))
    groups = every.unionByName(own).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("v"))
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g")).join(sizes, "lang", "left")
    langs = work.write(listed.select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("all_n"), F.coalesce("v", F.lit(0).cast("long")).alias("v")), "langs")

    salted = langs.where("v > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = chunks.withColumn("salt", F.pmod(F.hash(F.element_at("terms", 1)), F.lit(SALTS))).join(salted, ["lang", "salt"])
    scored = met.select("lang", "terms", "sources", "src", "id", "n", "all_sources", "all_n", "v").mapInArrow(lambda it: _scored(it, top, bounds), "lang string, source string, part string, item string, value long")
    scored = work.write(scored, "scored")
    bare = langs.where("v = 0").select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).where("source <> item")
    pairs = scored.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(bare.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(scored.where("part = 'term'")).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
