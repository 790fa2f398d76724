"""SentencePiece encoding and decoding by a table of the corpus's distinct chunks.

A text is escaped as the model's normaliser does (a marker before it, spaces to markers) and cut into
marked words: a run of markers and what follows up to the next marker. Where no piece of the model
holds a marker after another character, no merge crosses such a cut, so that each distinct marked word of
the corpus is segmented once. Tasks send the distinct words of their texts by ranges of a hash; each range
is merged, segmented and written to the shared folder as sorted 128-bit hashes with the words' ids. Workers
memory-map these files, look up the different words of a slice of texts, and join their ids by position: words
are moved between machines, positions are not. Models whose pieces cross markers, or whose normaliser does
more than mark spaces, are applied to whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared_files import map_file, write_file
from tidemark.llm.words import mix, powers, utf8
from tidemark.work import Work

MARK = "▁"
PART_BYTES = 32 << 20  # of text to a range of words
MOST_PARTS = 4096
HELD_BYTES = 64 << 20  # of words that a task keeps before it sends them, or of a worker's store of found words
ROWS = 256  # texts handled at once
SLICE = 4 << 20  # characters handled at once, or one text
END = b"\xff"  # after each word that is sent: no byte of UTF-8
_CODES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for seed in (41, 42)]


class Pieces:
    """What a model says of its pieces, and the segmentation of marked words."""

    def __init__(self, model: str | bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        size = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(size)]
        crossing = any(MARK in p.lstrip(MARK) for p in self.pieces)
        probe = " a Åﬁ  é\t\n　x "
        raw = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(self.pieces) if self.sp.is_byte(i)}
        # byte pieces spell what no other piece does, so that nothing is unknown
        self.plain = self.sp.normalize(probe) == MARK + probe.replace(" ", MARK) and not crossing and len(raw) == 256
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.said = [raw.get(i, b"" if self.sp.is_control(i) else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.digits = [b"%d," % i for i in range(size)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of marked words, given with one space for each marker; the first marker is the one that the library adds."""
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        lone = [self.sp.piece_to_id(MARK)]  # the empty text has no marker
        return [lone if c == " " else ids for c, ids in zip(chunks, found)]


_CUT = re.compile(" +[^ ]*")


def chunks_of(text: str) -> list[str]:
    """The marked words of a text, with one space for each marker; an empty text has none."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _CUT.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def hashes(chunks: list[bytes]) -> np.ndarray:
    """128 bits of each chunk as two columns, in blocks of bounded size."""
    out = np.empty((len(chunks), 2), np.uint64)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(lengths)
    i = 0
    while i < len(chunks):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20))))
        buf, n = np.frombuffer(b"".join(chunks[i:j]), np.uint8), lengths[i:j]
        starts = np.cumsum(n) - n
        weight = powers(int(n.max()) + 1)[np.arange(len(buf)) - np.repeat(starts, n)]
        for k, code in enumerate(_CODES):
            out[i:j, k] = mix(np.add.reduceat(code[buf] * weight, starts) + n.astype(np.uint64))
        i = j
    return out


def _distinct(batches, parts: int):
    """The distinct marked words of a task's texts, by range of their hash."""
    held: set[str] = set()
    size = 0

    def send():
        words = [w.encode() for w in held]
        to = _range(hashes(words)[:, 0], parts)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = sorted(words[k] for k in order[cuts[p] : cuts[p + 1]].tolist())
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "data": pa.array([_zip(END.join(own))], pa.binary())})

    for batch in batches:
        for raw in utf8(batch.column(0)):
            new = set(chunks_of(raw.decode("utf-8", "replace"))) - held
            held |= new
            size += sum(map(len, new))
            if size > HELD_BYTES:
                yield from send()
                held, size = set(), 0
    if held:
        yield from send()


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _segmented(folder: str, model):
    """Merge and segment the words of a range, and write their table: n, the hashes' first and second halves, where ids begin, ids."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[bytes] = set()
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")).to_pylist():
                words.update(_unzip(data).split(END))
        chunks = list(words)
        words.clear()
        h = hashes(chunks)
        order = np.lexsort((h[:, 1], h[:, 0]))
        pieces = Pieces(model.value)
        parts, counts = [], [np.zeros(1, np.int64)]
        for at in range(0, len(order), 1 << 14):
            ids = pieces.segment([chunks[k].decode() for k in order[at : at + (1 << 14)].tolist()])
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter((i for x in ids for i in x), pieces.kind, int(counts[-1].sum())))
        h, bounds = h[order], np.cumsum(np.concatenate(counts))
        p = key[0].as_py()
        head = np.array([len(h)], np.uint64)
        write_file(f"{folder}/words-{p}", b"".join([head.tobytes(), h[:, 0].tobytes(), h[:, 1].tobytes(), bounds.astype(np.uint64).tobytes(), *(x.tobytes() for x in parts)]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    return run


class Table:
    """The ids of the corpus's marked words, mapped range by range on first use, with a bounded store of those found."""

    def __init__(self, folder: str, parts: int, kind):
        self.folder, self.parts, self.kind = folder, parts, kind
        self.maps: dict[int, tuple[np.ndarray, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.size = 0
        self.start, self.count, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def map(self, p: int) -> tuple[np.ndarray, ...]:
        if p not in self.maps:
            raw = map_file(f"{self.folder}/words-{p}")
            n = int(raw[:8].view(np.uint64)[0])
            at = [8, 8 + 8 * n, 8 + 16 * n, 16 + 24 * n]
            self.maps[p] = (*(raw[a:b].view(np.uint64) for a, b in zip(at, at[1:])), raw[at[3] :].view(self.kind))
        return self.maps[p]

    def learn(self, words: list[str]) -> None:
        """Find words that the store does not have."""
        raw = [w.encode() for w in words]
        h = hashes(raw)
        to = _range(h[:, 0], self.parts)
        start, count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(self.parts + 1))
        pools, size = [self.pool], len(self.pool)
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[p] : cuts[p + 1]]
            one, two, bounds, ids = self.map(p)
            at = np.searchsorted(one, h[own, 0])
            while True:  # words of one first half, if there are, lie next to each other
                other = np.flatnonzero(two[np.minimum(at, len(two) - 1)] != h[own, 1])
                if not len(other):
                    break
                at[other] += 1
                if (at >= len(one)).any() or (one[at] != h[own, 0]).any():
                    raise ValueError("a marked word is not in the table: the texts have changed since it was made")
            first, n = bounds[at].astype(np.int64), np.diff(bounds)[at].astype(np.int64)
            start[own], count[own] = size + np.cumsum(n) - n, n
            pools.append(ids[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)])
            size += len(pools[-1])
        self.place.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start, self.count, self.pool = np.concatenate([self.start, start]), np.concatenate([self.count, count]), np.concatenate(pools)
        self.size += sum(map(len, raw)) + 200 * len(raw)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, its words' ids joined by position."""
        if self.size > HELD_BYTES:
            self.clear()
        cut = [chunks_of(t) for t in texts]
        new = set().union(*cut).difference(self.place)
        if new:
            self.learn(list(new))
        place = self.place
        at = np.array([place[c] for chunks in cut for c in chunks], np.int64)
        n = self.count[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.arange(upto[-1]) + np.repeat(self.start[at] - upto[:-1], n)]
        return np.split(out, upto[np.cumsum([len(x) for x in cut])][:-1])


def _read(spark, model: str) -> bytes:
    """The model file's bytes, by Spark's reader where the driver has no such local file."""
    import os

    if os.path.exists(model):
        with open(model, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(model).first()["content"])


def chunk_table(texts: DataFrame, model) -> tuple[str, int]:
    """Make the table of a one-column frame's distinct marked words; returns its folder and number of ranges.

    model: a broadcast of the model file's bytes.
    """
    work = Work(texts.sparkSession, "pieces")
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // PART_BYTES)))
    sent = texts.mapInArrow(lambda it: _distinct(it, parts), "part int, data binary")
    work.write(sent.groupBy("part").applyInArrow(_segmented(f"{work.path}/table", model), "part int, n long"), "parts")
    return f"{work.path}/table", parts


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode each whole text with a SentencePiece model, without begin or end ids, and decode it again.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs: digests of the ids in
    decimal joined by commas and of the decoded text. With texts, columns ids (array<int>) and decoded
    follow, then those named in keep as they are. Null texts are empty and have no ids; rows that repeat an id are
    encoded each; an empty table gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    raw = _read(spark, model)
    shared = spark.sparkContext.broadcast(raw)
    about = Pieces(raw)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"__{c}") for c in keep])
    table = chunk_table(source.select("text"), shared) if about.plain else None
    kind = about.kind

    def run(batches):
        pieces = Pieces(shared.value)
        known = Table(*table, kind) if table else None
        for whole in batches:
            for batch, found in _slices(whole):
                if known:
                    ids = known.ids(found)
                    spoken = [b"".join(map(pieces.said.__getitem__, i.tolist()))[1:] for i in ids]
                else:
                    ids = [np.array(i, np.int64) for i in pieces.sp.encode(found, num_threads=1)]
                    spoken = [pieces.sp.decode(i.tolist()).encode() for i in ids]
                joined = [b"".join(map(pieces.digits.__getitem__, i.tolist()))[:-1] for i in ids]
                columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in joined], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in spoken]}
                if texts:
                    columns["ids"] = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array([x.decode("utf-8", "replace") for x in spoken], pa.string())
                columns |= {f"__{c}": batch.column(2 + k) for k, c in enumerate(keep)}
                yield pa.RecordBatch.from_pydict(columns)

    more = ", ids array<int>, decoded string" if texts else ""
    kinds = dict(source.dtypes)
    more += "".join(f", `__{c}` {kinds[f'__{c}']}" for c in keep)
    out = source.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.select(*[F.col(f"`{c}`").alias(c.removeprefix("__")) for c in out.columns])


def _slices(whole: pa.RecordBatch):
    """Parts of a batch of at most ROWS texts and about SLICE bytes, with their texts."""
    found = [t.decode("utf-8", "replace") for t in utf8(whole.column(1))]
    start = size = 0
    for k, t in enumerate(found):
        if k > start and (k - start >= ROWS or size + len(t) > SLICE):
            yield whole.slice(start, k - start), found[start:k]
            start, size = k, 0
        size += len(t)
    if found:
        yield whole.slice(start), found[start:]
