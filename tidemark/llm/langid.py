"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text is the counts of its letters' n-grams of ORDERS bytes (words with their edges, letters folded),
hashed to BUCKETS, in logarithmic TF times IDF and of unit length. Each language has several centroids, found
by spherical k-means among its training texts; a text gets the language of the centroid of greatest cosine.
Texts farther from every centroid than nearly all training texts that are held back from the centroids are
rejected; shorter ones, which are farther by nature, than nearly all of these thinned to as many different n-grams.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.sampling import bounded_sample, fold
from tidemark.llm.words import FOLD, blocks, utf8

BUCKETS = 4096
ORDERS = (2, 3)
CENTROIDS = 4  # of each language
STEPS = 12
FAR = 0.001  # quantile of the cosines of held-back training texts below which texts are rejected
DRAWS = 1000  # thinned texts of each size at least
LONG = 64  # different n-grams from which texts count as whole
PER_LANG = 800  # training texts of each language about at most
IN_ALL = 16_000  # training texts of all languages about at most
SHARP = 24.0  # of the softmax over languages that gives the score
UNKNOWN = "und"
LETTERS = FOLD.copy()
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32
_ASCII = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def counts(texts: list[bytes]) -> np.ndarray:
    """n-gram counts of each text, a row of BUCKETS each."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for buf, offsets, first in blocks(texts):
        b = np.full(len(buf) + 2, 32, np.uint8)
        b[1:-1] = LETTERS[buf]
        doc = np.zeros(len(b), np.int32)
        doc[offsets[1:]] = 1
        doc = np.cumsum(doc, dtype=np.int32) * BUCKETS
        wide = b.astype(np.uint32)
        space = b == 32
        for n in range(2, max(ORDERS) + 1):
            if len(b) < n:
                break
            wide = wide[: len(b) - n + 1] | (b[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1)))
            if n not in ORDERS:
                continue
            m = len(wide)
            # no edge but at the ends, and not only edges
            good = ~space[1:m + 1] if n == 3 else ~(space[:m] & space[1 : m + 1])
            at = doc[:m][good] + ((wide[good] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)
            found = np.bincount(at, minlength=len(offsets) * BUCKETS)
            out[first : first + len(offsets)] += found.reshape(len(offsets), BUCKETS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.least = langs, idf, centroids, owner, least

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the text is rejected, of each text."""
        if not texts:
            return []
        tf = counts(texts)
        near = vectors(tf, self.idf) @ self.centroids.T
        least = self.least[lengths(tf)]
        best = np.stack([near[:, self.owner == k].max(1) for k in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        out = []
        for raw, sims, far in zip(texts, best, least):
            if not len(sims) or not has_letter(raw):
                out.append((UNKNOWN, 0.0, True))
                continue
            k = int(sims.argmax())
            p = np.exp(SHARP * (sims - sims[k]))
            out.append((self.langs[k], float(1 / p.sum()), bool(sims[k] < far)))
        return out


def lengths(tf: np.ndarray) -> np.ndarray:
    """Number of different n-grams of each text, in half powers of two."""
    return np.floor(2 * np.log2(np.maximum((tf > 0).sum(1), 1))).astype(int)


def centres(v: np.ndarray, label: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of each of n languages by spherical k-means, and their languages."""
    found, owner = [], []
    for k in range(n):
        own = v[label == k]
        c = own[rng.choice(len(own), min(CENTROIDS, len(own)), replace=False)]
        for _ in range(STEPS if len(own) else 0):
            to = (own @ c.T).argmax(1)
            c = np.stack([own[to == j].mean(0) if (to == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        found.append(c)
        owner += [k] * len(c)
    return np.concatenate(found), np.array(owner)


def bounds(tf: np.ndarray, v: np.ndarray, label: np.ndarray, n: int, idf: np.ndarray, rng) -> np.ndarray:
    """Least cosine of each length: a low quantile of training texts, whole and thinned, to centroids of the other half."""
    half = np.zeros(len(tf), int)
    for k in range(n):
        half[rng.permutation(np.flatnonzero(label == k))[::2]] = 1
    at, near, whole = [], [], []
    for h in range(2):
        # a language of one text has no other half
        rest = (half != h) | (np.bincount(label, minlength=n)[label] < 2)
        c = centres(v[rest], label[rest], n, rng)[0]
        held = tf[half == h]
        whole.append((v[half == h] @ c.T).max(1)[(held > 0).sum(1) >= LONG])
        if not len(held):
            continue
        many = np.repeat(np.arange(len(held)), -(-DRAWS // len(held)))
        for size in 2 ** np.arange(1, 13):
            for k in range(0, len(many), 256):  # in parts, for the driver's memory
                own = held[many[k : k + 256]].astype(np.int64)
                some = rng.binomial(own, np.minimum(1, size / np.maximum(own.sum(1, keepdims=True), 1))).astype(np.float32)
                some = some[some.any(1)]
                at.append(lengths(some))
                near.append((vectors(some, idf) @ c.T).max(1) if len(some) else np.empty(0, np.float32))
    at, near, whole = np.concatenate(at), np.concatenate(near), np.concatenate(whole)
    least = np.zeros(2 * BUCKETS.bit_length())
    for k in range(len(least)):
        own = near[at == k]
        least[k] = np.quantile(own, FAR) if len(own) >= DRAWS // 5 else least[k - 1] if k else 0.0
    least = np.minimum.accumulate(least[::-1])[::-1]
    return np.minimum(least, np.quantile(whole, FAR)) if len(whole) else least


def train(tf: np.ndarray, langs: list[str], seed: int = 11) -> Model:
    """Fit IDF, the centroids of each language and the distance beyond which texts are rejected."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(2 * BUCKETS.bit_length()))
    rng = np.random.default_rng(seed)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    v = vectors(tf, idf)
    label = np.array([names.index(x) for x in langs])
    centroids, owner = centres(v, label, len(names), rng)
    return Model(names, idf, centroids.astype(np.float32), owner, bounds(tf, v, label, len(names), idf, rng))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int, per_lang: int) -> Model:
    """A model of the labelled texts outside the held-out fold, about per_lang of each language and IN_ALL of all at most."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    sample = bounded_sample(known, "doc_id", "lang", per_lang, IN_ALL)
    rows = sample.mapInArrow(_sampled, "doc_id long, lang string, tf binary").toPandas().sort_values(["doc_id", "lang", "tf"])
    tf = np.zeros((len(rows), BUCKETS), np.float32)
    for i, x in enumerate(rows.pop("tf")):
        tf[i] = np.frombuffer(x, np.uint16)
    return train(tf, rows["lang"].tolist())


def _sampled(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = utf8(part.column(2))
            good = np.array([has_letter(t) for t in texts], bool)
            tf = np.minimum(counts(texts), 65535).astype(np.uint16)
            out = pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang": part.column(1), "tf": pa.array([x.tobytes() for x in tf], pa.binary())})
            yield out.filter(pa.array(good))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_lang: int = PER_LANG, model: Model | None = None) -> DataFrame:
    """The language of every whole text.

    Returns (doc_id, held_out, lang_pred, score, rejected), one row per row of docs. Learns from non-null
    languages outside the held-out fold, unless a model is given. A null text, or one without a letter, is
    `und` with score 0 and rejected; otherwise lang_pred is a learned language, the score its softmax
    share, and rejected tells whether every centroid is too far. Where nothing can be learned all are `und`.
    """
    spark = docs.sparkSession
    model = model or fit(docs, id_col, text_col, lang_col, folds, held, per_lang)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lang, score, far = zip(*shared.value.predict(utf8(part.column(1))))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang_pred": list(lang), "score": pa.array(score, pa.float64()), "rejected": list(far)})

    found = source.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    spark = docs.sparkSession
    model = options.pop("model", None) or fit(docs, options.get("id_col", "doc_id"), text_col, options.get("lang_col", "lang"), options.get("folds", 3), options.get("held", 1), options.get("per_lang", PER_LANG))
    shared = spark.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield part.filter(pa.array([not far for _, _, far in shared.value.predict(utf8(part.column(at_text)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
