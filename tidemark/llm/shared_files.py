"""Files of raw arrays in the shared folder: written whole by tasks, memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a second attempt of a task replaces the same bytes."""
    part = f"{uri}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as f:
            f.write(data)
        os.replace(_local(part), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(part)
    with store.open_output_stream(path) as f:
        f.write(data)
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped; from a remote store by an unlinked local copy."""
    if path := _local(uri):
        with open(path, "rb") as f:
            return _mapped(f)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
        while chunk := source.read(1 << 22):
            f.write(chunk)
        f.flush()
        return _mapped(f)


def _mapped(f) -> np.ndarray:
    if not os.fstat(f.fileno()).st_size:
        return np.empty(0, np.uint8)
    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays as one file that map_arrays maps: a JSON line of kinds and shapes, then each at a multiple of 64 bytes."""
    import json

    about = {k: [a.dtype.str, a.shape] for k, a in arrays.items()}
    parts = [json.dumps(about).encode() + b"\n"]
    size = len(parts[0])
    for a in arrays.values():
        parts += [bytes(-size % 64), np.ascontiguousarray(a).tobytes()]
        size += len(parts[-2]) + len(parts[-1])
    write_file(uri, b"".join(parts))


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    import json

    raw = map_file(uri)
    at = bytes(raw[: 1 << 16]).index(b"\n") + 1
    out = {}
    for k, (kind, shape) in json.loads(bytes(raw[: at - 1])).items():
        at += -at % 64
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[k] = raw[at : at + n].view(kind).reshape(shape)
        at += n
    return out
