"""Quality by Bradley-Terry pairwise ranking: scores learnt from preference pairs, then a threshold by quantile.

Of two labelled texts the one of quality 1 is preferred. A text's strength is linear in its features,
and the odds of a preference are the exponential of the difference of strengths, so that the loss is
logistic in differences of features. Every labelled text outside the held-out fold takes part: groups of such
texts hold both labels, and within a group each text meets PARTNERS or more of the other label. Tasks add up the loss, its
gradient and its curvature, and Newton's steps follow. The threshold is the exact quantile of all training strengths that
leaves the labelled share of good texts above it; scores are logistic in the distance from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.sampling import fold
from tidemark.llm.words import hash_words, spans, utf8, FOLD
from tidemark.work import Work

GROUPS = 4096  # groups that labelled rows are dealt to at most, a power of two
GROUP_ROWS = 64  # rows of the rarer label that a group is to hold at least
PARTNERS = 8
STEPS = 25
SHRINK = 1e-4
BINS = 4096  # ranges of strengths that are counted at once
PREDICTED = 0.7
PART = 1 << 20
_ASCII = np.arange(256)
UPPER = (_ASCII >= 65) & (_ASCII <= 90)
LOWER = (_ASCII >= 97) & (_ASCII <= 122)
HIGH = _ASCII >= 128
DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
STOP = np.isin(_ASCII, [ord(c) for c in ".,;:?'\"-"])
SYMBOL = ~(UPPER | LOWER | HIGH | DIGIT | STOP) & (_ASCII > 32)
CLASS = (UPPER * 1 + LOWER * 2 + HIGH * 3 + DIGIT * 4 + STOP * 5 + SYMBOL * 6 + (_ASCII == 10) * 7).astype(np.int64)
FEATURES = 18


def features(raw: bytes) -> np.ndarray:
    """What a text looks like: shares of kinds of characters, words, repeats. An empty text has zeros but for the first."""
    out = np.zeros(FEATURES)
    if not raw.strip():
        out[0] = 1
        return out
    kinds, hashes, lines, lengths, marked, at = np.zeros(8), [], [], [], 0, 0
    while at < len(raw):
        to = min(len(raw), at + PART)
        if to < len(raw):  # cut at a space where the part has one
            cut = max(raw.rfind(b" ", at, to), raw.rfind(b"\n", at, to))
            to = cut + 1 if cut > at else to
        buf = np.frombuffer(raw, np.uint8, to - at, at)
        kind = CLASS[buf]
        kinds += np.bincount(kind, minlength=8)
        s, e = spans(buf)
        hashes.append(hash_words(FOLD[buf], s, e))
        lengths.append(e - s)
        if len(e):
            marked += int((SYMBOL[buf[e - 1]]).sum())
        at = to
    for line in raw.split(b"\n"):
        if line.strip():
            lines.append(hash(line.strip()))
    h, length = np.concatenate(hashes), np.concatenate(lengths)
    n, size = max(1, len(h)), max(1.0, kinds.sum())
    letters = max(1.0, kinds[1] + kinds[2] + kinds[3])
    _, times = np.unique(h, return_counts=True)
    pairs = h[:-1] * np.uint64(31) + h[1:] * np.uint64(1000003)
    _, twice = np.unique(pairs, return_counts=True)
    out[1] = kinds[1] / letters
    out[2] = min(1.0, 4 * kinds[1] / letters)
    out[3] = kinds[6] / size
    out[4] = min(1.0, 30 * kinds[6] / size)
    out[5] = kinds[4] / size
    out[6] = kinds[5] / size
    out[7] = letters / size
    out[8] = marked / n
    out[9] = np.log1p(n) / 10
    out[10] = min(1.0, float(length.mean()) / 20)
    out[11] = len(times) / n
    out[12] = times.max() / n
    out[13] = (times[times > 1].sum()) / n
    out[14] = len(twice) / max(1, len(pairs)) if len(pairs) else 1.0
    out[15] = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    out[16] = len(set(lines)) / max(1, len(lines))
    out[17] = min(1.0, len(lines) / n)
    return out


class Ranker:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cut: float):
        self.mean, self.scale, self.w, self.cut = mean, scale, w, cut

    def strength(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, PREDICTED at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + np.log(PREDICTED / (1 - PREDICTED)), -40, 40)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features with bounded tails, and their squares."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 4], 1)


def differences(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A group's preference pairs, as differences of good and bad rows: each row is in PARTNERS pairs or more."""
    z = expand((x - mean) / scale)
    yes, no = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = sorted((yes, no), key=len)
    i = np.repeat(np.arange(len(many)), PARTNERS)
    j = np.arange(len(i)) % len(few)
    pairs = z[many[i]] - z[few[j]]
    return pairs if many is yes else -pairs


def curvature(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of pairs d at weights w: their number, the sums of the loss, of its gradient and of its second derivatives."""
    m = d @ w
    p = 1 / (1 + np.exp(np.clip(m, -40, 40)))
    return np.concatenate([[len(d), np.logaddexp(0, -m).sum()], -(p @ d), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def group_count(counts: dict[tuple[int, int], int]) -> int:
    """The largest number of groups, a power of two, of which each holds both labels: counts by (place below GROUPS, label)."""
    n = np.zeros((GROUPS, 2), np.int64)
    for (place, label), k in counts.items():
        n[place, label] = k
    while len(n) > 1 and n.min() < min(GROUP_ROWS, n.sum(0).min()):
        n = n[: len(n) // 2] + n[len(n) // 2 :]
    return len(n)


def train(rows: DataFrame) -> Ranker:
    """Fit strengths to preference pairs of all rows (doc_id, label, x); the driver sees sums and counts of groups only."""
    spark, width = rows.sparkSession, 2 * FEATURES
    place = F.pmod(F.xxhash64(F.lit("group"), F.col("doc_id").cast("string")), F.lit(GROUPS))
    counts = {(r["place"], r["label"]): r["count"] for r in rows.groupBy(place.alias("place"), "label").count().collect()}
    n = [sum(k for (_, label), k in counts.items() if label == of) for of in (0, 1)]
    if not all(n):
        return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(width), 0.0 if n[1] or not n[0] else 1.0)
    work = Work(spark, "quality_training")
    groups = group_count(counts)
    # a group's rows lie together and in one order, so that reruns add the same numbers in the same order
    rows = work.write(rows.withColumn("of", F.pmod(place, F.lit(groups))).repartition(F.col("of")).sortWithinPartitions("of", "doc_id", "label", "x"), "rows")

    def summed(function, size: int) -> np.ndarray:
        """Sums over all groups of function (x, label) -> array, added in the groups' order."""

        def run(table: pa.Table) -> pa.Table:
            x = np.stack([np.frombuffer(b) for b in table["x"].to_pylist()])
            return pa.table({"of": table["of"].slice(0, 1), "v": pa.array([function(x, table["label"].to_numpy()).tobytes()], pa.binary())})

        found = rows.groupBy("of").applyInArrow(run, "of long, v binary").sort("of").toLocalIterator()
        total = np.zeros(size)
        for r in found:
            total += np.frombuffer(r["v"])
        return total

    half = lambda x, y, of: (lambda z: np.concatenate([z.sum(0), (z * z).sum(0)]) / (2 * n[of]))(x[y == of])
    moments = summed(lambda x, y: half(x, y, 0) + half(x, y, 1), width)  # both labels weigh the same
    mean = moments[:FEATURES]
    scale = np.maximum(np.sqrt(np.maximum(moments[FEATURES:] - mean * mean, 0)), 1e-6)
    w, last, step = np.zeros(width), np.inf, np.zeros(width)
    for _ in range(STEPS):
        sums = summed(lambda x, y: curvature(differences(x, y, mean, scale), w), 2 + width + width * width)
        loss = sums[1] / sums[0] + SHRINK / 2 * (w @ w)
        if loss > last:  # too far
            step = step / 2
            w = w - step
        else:
            slope = sums[2 : 2 + width] / sums[0] + SHRINK * w
            if loss > last - 1e-9:
                break
            last, step = loss, -np.linalg.solve(sums[2 + width :].reshape(width, width) / sums[0] + SHRINK * np.eye(width), slope)
            w = w + step
    ranker = Ranker(mean, scale, w, 0.0)

    def strengths(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"s": pa.array(ranker.strength(np.stack([np.frombuffer(b) for b in batch.column(0).to_pylist()])), pa.float64())})

    s = work.write(rows.select("x").mapInArrow(strengths, "s double"), "strengths")
    a = at_rank(s, n[0] - 1)
    upto, b = s.agg(F.count_if(F.col("s") <= a), F.min(F.when(F.col("s") > a, F.col("s")))).first()
    ranker.cut = (a + (a if upto > n[0] else b)) / 2
    work.drop()
    return ranker


def at_rank(values: DataFrame, k: int) -> float:
    """The value of column s that has k values before it in ascending order, by counts in ever narrower ranges."""
    s, before = F.col("s"), 0
    lo, hi = values.agg(F.min(s), F.max(s)).first()
    while lo < hi:
        at = F.when(s == hi, BINS - 1).otherwise(F.least(F.floor((s - lo) / (hi - lo) * BINS), F.lit(BINS - 1)))
        for r in values.where(s.between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi")).sort("bin").collect():
            if before + r["n"] > k:
                lo, hi = r["lo"], r["hi"]
                break
            before += r["n"]
    return lo


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2) -> DataFrame:
    """Score every whole text for quality, learning from all labelled rows outside the held-out fold.

    Returns (doc_id, held_out, score, predicted), one row per row of docs. Texts are read once, for their features, which are
    written; training and scores read these. Null and empty texts share one score. Null
    labels are left out, and a label that is repeated for one id counts once; with one label only, or none, all texts
    have the same score. A text whose strength ties with the threshold is predicted 1. Rows of one id are scored each by its text. Other columns of docs and labels are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(fold("doc_id", folds) != held).distinct()
    seen = Work(spark, "quality").write(source.mapInArrow(_features, "doc_id long, x binary"), "features")
    shared = spark.sparkContext.broadcast(train(seen.join(known, "doc_id").select("doc_id", "label", "x")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = shared.value.score(np.stack([np.frombuffer(b) for b in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(score, pa.float64())})

    scored = seen.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


def _features(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.array([features(t).tobytes() for t in utf8(batch.column(1))], pa.binary())})
