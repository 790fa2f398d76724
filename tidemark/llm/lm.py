"""LM scoring by an interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are 64-bit hashes, and numbers once all are known. Tasks count the distinct words and bigrams of
their own texts and send them as packed sorted arrays by ranges of the hash; each range is merged,
counted in full, and written to the shared folder as sorted hash arrays. Workers memory-map these to
score texts. The model of a text is that of its words and an end, each after the word before it:

    p(w | u) = (c(uw) - D(c(uw))) / c(u) + g(u) p'(w),    p'(w) = (k(w) - D'(k(w))) / B + g' / (V + 1)

c counts bigrams, k(w) the distinct words before w, B all distinct bigrams; D and D' are the modified
discounts for counts of 1, 2 and 3 or more, and g(u), g' what they free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.packed import pack, unpack
from tidemark.llm.sampling import fold
from tidemark.llm.shared_files import map_file, write_file
from tidemark.llm.words import mix, utf8, word_hashes
from tidemark.work import Work

PART_BYTES = 32 << 20  # of training text to a range
TOKENS = 1 << 20  # handled at once
HELD = 3 << 20  # distinct entries that a task keeps before it sends them
MOST_MAPS = 16_384  # files that a worker maps at once
MOST_WORDS = (1 << 32) - 2  # words that numbers of 32 bits can tell apart
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A4700000000001)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by an end, and the bounds of each text."""
    h, bounds = word_hashes(texts)
    out = np.insert(h, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def portions(batches, at: int):
    """(batch, tokens, bounds) of slices with about TOKENS words."""
    for batch in batches:
        lengths = np.cumsum([len(x) for x in utf8(batch.column(at))])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(lengths, (lengths[start - 1] if start else 0) + 6 * TOKENS)))
            part = batch.slice(start, end - start)
            yield part, *tokens(utf8(part.column(at)))
            start = end


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class Counter:
    """Distinct keys with counts, sent by range of the key's order when there are many."""

    def __init__(self, bits: int, order, packed):
        self.bits, self.order, self.packed, self.held, self.n = bits, order, packed, [], 0

    def add(self, keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        self.held.append((keys, counts.astype(np.uint64)))
        self.n += len(keys)
        if self.n > HELD:
            yield from self.send() if len(self.held) == 1 or self.merge() > HELD // 2 else ()

    def merge(self) -> int:
        self.held = [summed(*(np.concatenate(x) for x in zip(*self.held)))]
        self.n = len(self.held[0][0])
        return self.n

    def send(self):
        if self.held:
            self.merge()
            keys, counts = self.held[0]
            to = part_of(self.order(keys), self.bits)
            for p in np.unique(to):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "data": pa.array([self.packed(keys[to == p], counts[to == p])], pa.binary())})
        self.held, self.n = [], 0


def _words(batches, bits):
    counter = Counter(bits, lambda k: k, lambda k, c: pack(k, c))
    for _, h, _ in portions(batches, 0):
        yield from counter.add(h)
    yield from counter.send()


def _merge_words(folder):
    def run(key, table):
        keys, counts = summed(*(np.concatenate(x) for x in zip(*(unpack(d, np.uint64, np.uint64) for d in table.column("data").to_pylist()))))
        p = key[0].as_py()
        write_file(f"{folder}/words-{p}", keys.tobytes() + counts.tobytes())
        return pa.table({"part": pa.array([p], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


class Words:
    """The words of the training texts by hash: numbers and, once written, their figures."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]):
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.starts = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(1 << bits)])])
        self.maps: dict[str, np.ndarray] = {}

    def map(self, name: str) -> np.ndarray:
        if name not in self.maps:
            if len(self.maps) >= MOST_MAPS:  # the one that was mapped first goes
                self.maps.pop(next(iter(self.maps)))
            self.maps[name] = map_file(f"{self.folder}/{name}")
        return self.maps[name]

    def find(self, h: np.ndarray, figures: bool = False) -> list[np.ndarray]:
        """Of sorted hashes the word numbers, -1 for none; and with figures (count, words before, freed share)."""
        number = np.full(len(h), -1, np.int64)
        rest = [np.zeros(len(h)) for _ in range(3)] if figures else []
        to = part_of(h, self.bits)
        cuts = np.searchsorted(to, np.arange((1 << self.bits) + 1))
        for p in np.unique(to).tolist():
            n = self.sizes.get(p, 0)
            if not n:
                continue
            own = slice(cuts[p], cuts[p + 1])
            both = self.map(f"words-{p}").view(np.uint64)
            at = np.minimum(np.searchsorted(both[:n], h[own]), n - 1)
            hit = both[:n][at] == h[own]
            number[own] = np.where(hit, at + self.starts[p], -1)
            if figures:
                more = self.map(f"figures-{p}").view(np.float64)
                rest[0][own] = np.where(hit, both[n:][at].astype(np.float64), 0)
                rest[1][own], rest[2][own] = np.where(hit, more[:n][at], 0), np.where(hit, more[n:][at], 0)
        return [number, *rest]


def _codes(number: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """Bigram codes by word numbers: the number before each token (start: of a text's first) and its own."""
    before = np.concatenate([[start], number[:-1]])
    before[bounds[:-1]] = start
    return (before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)


def _bigrams(batches, vocabulary, bits, start):
    counter = Counter(bits, mix, lambda k, c: pack((k >> np.uint64(32)).astype(np.uint32), k.astype(np.uint32), c.astype(np.uint32)))
    for _, h, bounds in portions(batches, 0):
        distinct, of = np.unique(h, return_inverse=True)
        number = vocabulary.find(distinct)[0][of]
        yield from counter.add(_codes(number, bounds, start))
    yield from counter.send()


def _merge_bigrams(folder, bits, starts):
    """Write a range of bigrams; return counts of counts and, by range of words, what the bigrams say of them."""

    def run(key, table):
        p = key[0].as_py()
        got = [unpack(d, np.uint32, np.uint32, np.uint32) for d in table.column("data").to_pylist()]
        code = np.concatenate([(u.astype(np.uint64) << np.uint64(32)) | w for u, w, _ in got])
        code, count = summed(code, np.concatenate([c for _, _, c in got]).astype(np.uint64))
        h = mix(code)
        order = np.argsort(h)
        few = np.minimum(count[order], 255).astype(np.uint8)
        many = order[count[order] >= 255]
        write_file(f"{folder}/bigrams-{p}", b"".join([len(h).to_bytes(8, "little"), h[order].tobytes(), h[many].tobytes(), count[many].tobytes(), few.tobytes()]))
        u, w = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(count, 3).astype(np.int64) - 1
        rows = {"words": [-1], "data": [pack(np.arange(4, dtype=np.uint64), np.array([(count == i).sum() for i in (1, 2, 3, 4)], np.uint64))]}
        kinds = [(kind == i).astype(np.uint64) for i in range(3)]
        of_u = summed(u, *kinds)
        of_w = summed(w, np.ones(len(w), np.uint64))
        for tag, (numbers, *values) in ((0, of_w), (1, of_u)):
            to = np.searchsorted(starts, numbers, side="right") - 1
            cuts = np.searchsorted(to, np.arange(len(starts) + 1))
            for q in np.unique(to).tolist():
                own = slice(cuts[q], cuts[q + 1])
                rows["words"].append(2 * q + tag)
                rows["data"].append(pack((numbers[own] - starts[q]).astype(np.uint32), *(v[own].astype(np.uint32) for v in values)))
        return pa.table({"words": pa.array(rows["words"], pa.int32()), "data": pa.array(rows["data"], pa.binary())})

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified discounts for counts of 1, 2 and 3 or more, from the numbers of entries counted 1 to 4 times."""
    n = np.maximum(np.asarray(n, float), 0)
    if n[0] <= 0 or n[0] + 2 * n[1] <= 0:
        return np.array([0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([np.clip(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05, i + 0.95) if n[i] > 0 else 0.5 for i in range(3)])


def _figures(folder, sizes, d, texts, start_part):
    """Write k(w) and g(u) of a range of words; return its counts of k and, for the start, g."""

    def run(key, table):
        p = key[0].as_py()
        n = sizes.get(p, 0)
        k, freed = np.zeros(n + 1), np.zeros(n + 1)
        for tag, data in zip(table.column("tag").to_pylist(), table.column("data").to_pylist()):
            if tag == 0:
                at, v = unpack(data, np.uint32, np.uint32)
                k[at] += v
            else:
                at, *v = unpack(data, *[np.uint32] * 4)
                freed[at] += sum(x * y for x, y in zip(v, d))
        counted = map_file(f"{folder}/words-{p}").view(np.uint64)[n:] if n else np.empty(0)
        g = freed[:n] / np.maximum(1, counted)
        write_file(f"{folder}/figures-{p}", k[:n].tobytes() + g.tobytes())
        values = [(k == i).sum() for i in (1, 2, 3, 4)] + [k.sum()]
        return pa.table({"counts": pa.array([[float(x) for x in values]], pa.list_(pa.float64())), "opening": pa.array([float(freed[n]) / max(1, texts) if p == start_part else 0.0], pa.float64())})

    return run


class Model:
    """What a worker needs to score texts; the arrays are mapped on first use."""

    def __init__(self, vocabulary: Words, bits: int, total: int, distinct: int, texts: int, d, d1, pairs: float, opening: float):
        self.vocabulary, self.bits, self.total, self.distinct, self.texts = vocabulary, bits, total, distinct, texts
        self.d, self.d1, self.pairs, self.opening = d, d1, pairs, opening

    def counts(self, code: np.ndarray) -> np.ndarray:
        """Counts of bigram codes."""
        h = mix(code)
        order = np.argsort(h)
        h = h[order]
        found = np.zeros(len(h))
        to = part_of(h, self.bits)
        cuts = np.searchsorted(to, np.arange((1 << self.bits) + 1))
        for p in np.unique(to).tolist():
            own = slice(cuts[p], cuts[p + 1])
            raw = self.vocabulary.map(f"bigrams-{p}")
            n = int(raw[:8].view(np.uint64)[0])
            m = (len(raw) - 8 - 9 * n) // 16
            keys = raw[8 : 8 + 8 * n].view(np.uint64)
            rest = raw[8 + 8 * n : 8 + 8 * n + 16 * m].view(np.uint64)
            few = raw[8 + 8 * n + 16 * m :]
            at = np.minimum(np.searchsorted(keys, h[own]), n - 1)
            hit = keys[at] == h[own]
            c = np.where(hit, few[at], 0).astype(float)
            large = np.flatnonzero(c == 255)
            if len(large):
                c[large] = rest[m:][np.searchsorted(rest[:m], h[own][large])]
            found[own] = c
        out = np.empty(len(h))
        out[order] = found
        return out

    def score(self, h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Of each text: tokens, known ones, base score and score."""
        distinct, of = np.unique(h, return_inverse=True)
        number, count, before, free = (x[of] for x in self.vocabulary.find(distinct, True)) if self.total else (np.full(len(h), -1), *[np.zeros(len(h))] * 3)
        size = self.distinct + 1
        base = np.log10((count + 1) / (self.total + size))
        low = np.zeros(len(h))
        if self.pairs:
            kind = np.clip(before, 1, 3).astype(int) - 1
            low = np.where(before > 0, before - self.d1[0][kind], 0) / self.pairs
        low = low + self.d1[1] / size
        prior_count, prior_free = np.concatenate([[self.texts], count[:-1]]), np.concatenate([[self.opening], free[:-1]])
        prior_count[bounds[:-1]], prior_free[bounds[:-1]] = self.texts, self.opening
        start = int(self.distinct)
        prior = np.concatenate([[start], number[:-1]])
        prior[bounds[:-1]] = start
        known = np.flatnonzero((number >= 0) & (prior >= 0) & (prior_count > 0))
        both = np.zeros(len(h))
        if len(known):
            both[known] = self.counts((prior[known].astype(np.uint64) << np.uint64(32)) | number[known].astype(np.uint64))
        kind = np.clip(both, 1, 3).astype(int) - 1
        p = np.where(prior_count > 0, np.where(both > 0, both - self.d[kind], 0) / np.maximum(prior_count, 1) + prior_free * low, low)
        sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else x
        return [np.diff(bounds), sums((count > 0).astype(np.int64)), sums(base), sums(np.log10(p))]


def train(texts: DataFrame) -> Model:
    """Count a model of the texts of a one-column frame; its arrays stay in the shared folder."""
    spark = texts.sparkSession
    work = Work(spark, "lm")
    folder = f"{work.path}/arrays"
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length(texts.columns[0]))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, (size or 0) / PART_BYTES)))))
    sent = texts.mapInArrow(lambda it: _words(it, bits), "part int, data binary")
    merged = work.write(sent.groupBy("part").applyInArrow(_merge_words(folder), "part int, n long, total long"), "words").collect()  # a row for each range
    sizes, total = {r["part"]: r["n"] for r in merged}, sum(r["total"] for r in merged)
    distinct = sum(sizes.values())
    if distinct > MOST_WORDS:
        raise ValueError(f"{distinct} distinct words are more than numbers of 32 bits tell apart")
    vocabulary = Words(folder, bits, sizes)
    if not rows:
        return Model(vocabulary, bits, 0, 0, 0, np.full(3, 0.5), (np.full(3, 0.5), 1.0), 0, 0.0)
    starts = vocabulary.starts[:-1]
    sent = texts.mapInArrow(lambda it: _bigrams(it, vocabulary, bits, distinct), "part int, data binary")
    told = work.write(sent.groupBy("part").applyInArrow(_merge_bigrams(folder, bits, starts), "words int, data binary"), "bigrams")
    n = sum((unpack(r["data"], np.uint64, np.uint64)[1].astype(float) for r in told.where("words < 0").select("data").collect()), np.zeros(4))  # a row for each range
    d = discounts(n)
    start_part = int(np.searchsorted(starts, distinct, side="right") - 1)
    of_words = told.where("words >= 0").select((F.col("words") / 2).cast("int").alias("part"), (F.col("words") % 2).alias("tag"), "data")
    # ranges of words that no bigram tells of have no rows here; there are none, as each word ends a bigram
    made = work.write(of_words.groupBy("part").applyInArrow(_figures(folder, sizes, d, rows, start_part), "counts array<double>, opening double"), "figures").collect()
    k = np.sum([r["counts"] for r in made], 0)
    d1, pairs = discounts(k[:4]), float(k[4])
    more = max(0.0, distinct - k[:2].sum())
    freed = (d1[0] * k[0] + d1[1] * k[1] + d1[2] * more) / max(1.0, pairs)
    return Model(vocabulary, bits, total, distinct, rows, d, (d1, freed), pairs, sum(r["opening"] for r in made))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Score every whole text with a model of those outside the held-out fold.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs:
    scores are log10 probabilities of all words and the end, the base one by single words with one added
    to each count. Null texts are empty: an end alone. Rows without an id are never held out. With nothing to
    learn from, all words are unknown and equally likely.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out_of = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    model = train(source.where(~out_of).select("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for part, h, bounds in portions(batches, 1):
            n, known, base, found = model.score(h, bounds)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(found, pa.float64())})

    scored = source.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
