"""Vectorised words of UTF-8 texts: spans and 64-bit hashes in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are folded to lower case.
Texts are handled in blocks of about BLOCK bytes, cut between words, so that memory stays
bounded for a text of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64), _STEP)]))
    return _powers


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(SPACE[buf], out=word[1:-1].view(bool))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of a folded buffer."""
    if not len(starts):
        return np.empty(0, np.uint64)
    buf, starts, ends = buf[starts[0] :], starts - starts[0], ends - starts[0]
    at = np.arange(len(buf), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(buf))))
    length = ends - starts
    np.minimum(at, int(length.max()), out=at)  # beyond its end a word has separators only, of weight 0
    weight = _CODE[buf] * powers(int(length.max()) + 1)[at]
    return mix(np.add.reduceat(weight, starts) + length.astype(np.uint64))


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Folded buffers of whole words, with the text number that each part starts, and its offset.

    Yields (buffer, offsets, first): offsets[i] is where text first + i begins in the buffer. A text
    longer than a block comes alone, in parts cut between words, as (buffer, [0], number) again and again.
    """
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            if held:
                yield _joined(held, first)
                held, size = [], 0
            at = 0
            while at < len(t):
                to = min(len(t), at + BLOCK)
                while to < len(t):
                    tail = np.flatnonzero(SPACE[np.frombuffer(t, np.uint8, min(BLOCK, len(t) - to), to)])
                    to += int(tail[0]) if len(tail) else min(BLOCK, len(t) - to)
                    if len(tail):
                        break
                yield FOLD[np.frombuffer(t, np.uint8, to - at, at)], np.zeros(1, np.int64), i
                at = to
            first = i + 1
            continue
        if size + len(t) > BLOCK:
            yield _joined(held, first)
            held, size, first = [], 0, i
        held.append(t)
        size += len(t) + 1
    if held:
        yield _joined(held, first)


def _joined(held: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, int]:
    lengths = np.array([len(t) + 1 for t in held], np.int64)
    return FOLD[np.frombuffer(b" ".join(held), np.uint8)], np.concatenate([[0], np.cumsum(lengths)[:-1]]), first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the n + 1 bounds of each text in them."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for buf, offsets, first in blocks(texts):
        starts, ends = spans(buf)
        parts.append(hash_words(buf, starts, ends))
        counts[first : first + len(offsets)] += np.diff(np.append(np.searchsorted(starts, offsets), len(starts)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is the empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
