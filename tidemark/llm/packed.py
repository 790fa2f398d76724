"""Sorted arrays as compressed bytes."""

from __future__ import annotations

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of one length as compressed byte planes; the first is sorted and kept as differences."""
    import zstandard

    if not len(arrays[0]):
        return bytes(8)
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in (first, *arrays[1:])]
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    if not n:
        return [np.empty(0, kind) for kind in kinds]
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out
