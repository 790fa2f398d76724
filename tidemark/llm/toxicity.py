"""Toxicity by subword-bag embeddings: their average goes through a linear softmax, both trained jointly in numpy.

A text is the bag of the n-grams of its words, of ORDERS bytes with the words' edges, in folded letters; digits and
the symbols of SPELLING stand for letters in misspelt words and are kept. Each n-gram has a vector by hashed bucket,
a text the average of its n-grams' vectors, so that a misspelt or inflected word that was never seen shares
most of its vectors with words that were. Every bucket has a vector: it starts at the logarithm of the odds of toxic
against clean training texts that hold the bucket, drawn CAUTION standard errors towards none, and moves in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.packed import pack, unpack
from tidemark.llm.sampling import bounded_sample, fold
from tidemark.llm.words import FOLD, blocks, utf8

BITS = 20
ORDERS = (4, 5, 6, 7, 8)
DIM = 8
EPOCHS = 8
RATE = 0.05
CAUTION = 3.0
TOXIC_MASS = 0.2  # weight of all toxic texts in training against all clean ones
PER_LABEL = 2500  # labelled rows of each label that training takes about at most
MOST_GRAMS = 1 << 14  # different n-grams of a training text, of which longer ones show a drawn part
PREDICTED = 0.3
SPELLING = b"@$*#"
KEPT = FOLD.copy()
KEPT[[i for i in range(128) if not chr(i).isalnum() and i not in SPELLING]] = 32


def _buckets(buf: np.ndarray):
    """Of the n-grams of a folded buffer, order by order: where each begins, and its bucket."""
    b = np.full(len(buf) + 2, 32, np.uint8)
    b[1:-1] = KEPT[buf]
    # capital letters of two bytes C3 xx
    high = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
    b[high] += 32
    upto = np.concatenate([[0], np.cumsum(b == 32, dtype=np.int32)])
    code = b.astype(np.uint64)
    wide = code
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            return
        wide = wide[: len(b) - n + 1] | (code[n - 1 :] << np.uint64(8 * (n - 1)))
        if n in ORDERS:
            m = len(wide)
            inner = np.flatnonzero(upto[n - 1 : n - 1 + m] == upto[1 : 1 + m])  # no edge but at the ends
            h = (wide[inner] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            yield inner, (h >> np.uint64(64 - BITS)).astype(np.int32)


def subwords(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different n-gram buckets of each text, sorted, and how often each occurs."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for buf, offsets, first in blocks(texts):
        for at, bucket in _buckets(buf):
            for k, part in enumerate(np.split(bucket, np.searchsorted(at, offsets[1:]))):
                found[first + k].append(part)
    bags = [np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.int32), np.empty(0, np.int64)) for x in found]
    return [(b, np.minimum(c, 65535).astype(np.uint16)) for b, c in bags]


def drawn(bag: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A bag of MOST_GRAMS different n-grams at most: a text of more shows that many of them, drawn evenly."""
    b, c = bag
    if len(b) <= MOST_GRAMS:
        return bag
    some = np.sort(np.random.default_rng(len(b)).choice(len(b), MOST_GRAMS, replace=False))
    return b[some], c[some]


def _start(bags, labels) -> np.ndarray:
    """Of each bucket the cautious logarithm of the odds of toxic texts among those that hold it, against the others."""
    held = np.zeros((2, 1 << BITS), np.float32)
    for (b, _), y in zip(bags, labels):
        held[y, b] += 1
    a, c = held[1] + 0.5, held[0] + 0.5
    b, d = (labels == 1).sum() + 1 - a, (labels == 0).sum() + 1 - c
    odds = np.log(a * d / (b * c))
    sure = np.maximum(np.abs(odds) - CAUTION * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d), 0)
    return np.where(held.sum(0) > 0, np.copysign(sure, odds), 0).astype(np.float32)


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression in one variable, by damped Newton steps."""
    s = o = 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(s * x + o, -30, 30)))
        g, h = (p - y) * weight, weight * p * (1 - p)
        a, b, c = (h * x * x).sum() + 0.01, (h * x).sum(), h.sum() + 0.01
        gs, go = (g * x).sum() + 0.01 * s, g.sum()
        s, o = s - 0.5 * (c * gs - b * go) / (a * c - b * b), o - 0.5 * (a * go - b * gs) / (a * c - b * b)
    return float(s), float(o)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax together by gradient steps, a text at a time.

    Returns what scoring needs of them: the difference of the two classes' logits that each bucket's vector
    gives, and that of their offsets. With texts of one label only there is an offset alone.
    """
    labels = np.asarray(labels, np.int64)
    clean, toxic = int((labels == 0).sum()), int((labels == 1).sum())
    if not clean or not toxic:
        return np.zeros(1 << BITS, np.float32), float(np.log((toxic + 1) / (clean + 1)))
    rng = np.random.default_rng(seed)
    many = [np.float32(1 / max(1, int(c.sum()))) for _, c in bags]
    weight = np.where(labels == 1, TOXIC_MASS * clean / toxic, 1.0)
    gain = _start(bags, labels)
    mean = np.array([k * (c @ gain[b]) for (b, c), k in zip(bags, many)], float)
    spread = mean.std() + 1e-9
    slope, offset = _line(mean / spread, labels, weight)
    gain *= slope / spread
    # the average is scaled so that one text's vectors have about the length of one vector
    scale = 1 / (np.sqrt(np.mean([k * k * (c.astype(np.float32) ** 2).sum() for (_, c), k in zip(bags, many)])) + 1e-12)
    way = rng.normal(size=DIM).astype(np.float32)
    way /= np.linalg.norm(way)
    e = rng.standard_normal((1 << BITS, DIM), np.float32)
    e *= 1e-3
    for k in range(DIM):
        e[:, k] += gain * np.float32(way[k] / scale)
    w, o = np.stack([-way / 2, way / 2], 1), np.array([-offset / 2, offset / 2])
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(bags)):
            b, c = bags[i]
            x = c * many[i]
            h = scale * (x @ e[b])
            z = h @ w + o
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[i]
            e[b] -= rate * scale * np.outer(x, w @ p)
            w -= 0.01 * rate * np.outer(h, p)
            o -= 0.05 * rate * p
    return (scale * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32), float(o[1] - o[0])


def score_texts(texts: list[bytes], gain: np.ndarray, offset: float) -> np.ndarray:
    """Probability of toxicity of each text: the average over all its n-grams, through the softmax."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for buf, offsets, first in blocks(texts):
        own = slice(first, first + len(offsets))
        for at, bucket in _buckets(buf):
            cuts = np.concatenate([[0], np.searchsorted(at, offsets[1:]), [len(at)]])
            total[own] += np.diff(np.concatenate([[0], np.cumsum(gain[bucket], dtype=np.float64)])[cuts])
            n[own] += np.diff(cuts)
    return 1 / (1 + np.exp(-np.clip(offset + total / np.maximum(n, 1), -40, 40)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, per_label: int = PER_LABEL) -> DataFrame:
    """Score every whole text for toxicity, learning from labelled rows outside the held-out fold.

    Returns (doc_id, held_out, score, predicted), one row per row of docs. Training takes about per_label
    rows of each label at most, by the hash of their ids; toxic texts weigh TOXIC_MASS of the clean ones. Null or
    empty texts, and texts without a letter or digit, get the score of the offset alone. Null labels are left out;
    a label that is repeated for one id counts once, different labels of one id count each. Rows of one id are scored
    each by its text. With no labelled rows at all the score is 0.5. Other columns of docs and labels are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    sample = bounded_sample(known.where(fold("doc_id", folds) != held).distinct(), "doc_id", "label", per_label)
    # ids of about 2 * per_label rows
    fitted = source.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(_sampled, "doc_id long, label int, bag binary").toPandas()
    fitted = fitted.sort_values(["doc_id", "label", "bag"])
    y = fitted["label"].to_numpy(np.int64)
    bags = [(b.view(np.int32), c) for b, c in (unpack(x, np.uint32, np.uint16) for x in fitted.pop("bag"))]
    gain, offset = train(bags, y)
    shared = spark.sparkContext.broadcast((gain, offset))

    def run(batches):
        gain, offset = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(score_texts(utf8(part.column(1)), gain, offset), pa.float64())})

    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


def _sampled(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            bags = [drawn(x) for x in subwords(utf8(part.column(2)))]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "label": part.column(1), "bag": pa.array([pack(b.astype(np.uint32), c) for b, c in bags], pa.binary())})
