"""Arrays in files of the shared folder: written whole by a task, memory-mapped by workers."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np


def _fs(path: str):
    """A local path, or (file system, path) for a store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" not in path:
        return path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file for all arrays. It appears whole or not at all, so a task that is run twice does no harm."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    first = json.dumps(head).encode()
    first = len(first).to_bytes(8, "little") + first
    first += bytes(-len(first) % 64)
    where = _fs(folder)
    temp = f"{name}.{uuid.uuid4().hex}"
    if isinstance(where, str):
        os.makedirs(where, exist_ok=True)
        out = open(f"{where}/{temp}", "wb")
    else:
        where[0].create_dir(where[1], recursive=True)
        out = where[0].open_output_stream(f"{where[1]}/{temp}")
    with out:
        out.write(first)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 64))
    if isinstance(where, str):
        os.replace(f"{where}/{temp}", f"{where}/{name}")
    else:
        where[0].move(f"{where[1]}/{temp}", f"{where[1]}/{name}")


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The file's arrays, mapped. A file of a store is fetched into a temp file that is unlinked once it is mapped."""
    where = _fs(folder)
    if isinstance(where, str):
        data = np.memmap(f"{where}/{name}", np.uint8, "r")
    else:
        import shutil
        import tempfile

        with where[0].open_input_stream(f"{where[1]}/{name}") as src, tempfile.NamedTemporaryFile() as out:
            shutil.copyfileobj(src, out, 1 << 22)
            out.flush()
            data = np.memmap(out.name, np.uint8, "r")
    size = int.from_bytes(bytes(data[:8]), "little")
    start = -(-(8 + size) // 64) * 64
    return {k: data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in json.loads(bytes(data[8 : 8 + size])).items()}
