"""Tables of sorted 64-bit keys with values, written by Spark tasks and memory-mapped by others.

A store is a set of files in the shared folder, one for each shard: all keys of a shard in ascending
order, then one array for each value column. A task finds its keys by binary search in the mapped
files, so a lookup table may be far larger than a worker's memory and is neither broadcast nor joined by
shuffle. A file appears by renaming a finished one and its content depends on the input only, so a task
that runs again after a lost executor puts the same file in place.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..session import shared_dir

_OPEN: dict[tuple, tuple] = {}


def new_store(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _local(path: str) -> str | None:
    """The file-system path of a URI on a mounted folder, None for stores that cannot be mapped."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def write_shard(path: str, name: str, shard: int, *arrays: np.ndarray) -> None:
    data = b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    final, part = f"{name}-{shard}.bin", f"{name}-{shard}.{uuid.uuid4().hex}.part"
    if (root := _local(path)) is not None:
        os.makedirs(root, exist_ok=True)
        with open(f"{root}/{part}", "wb") as f:
            f.write(data)
        os.replace(f"{root}/{part}", f"{root}/{final}")
        return
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{part}") as f:
        f.write(data)
    fs.move(f"{root}/{part}", f"{root}/{final}")


def read_shard(path: str, name: str, shard: int, types: tuple, rest=None) -> list[np.ndarray]:
    """The arrays of a shard: mapped where the shared folder is mounted, else read; a shard without keys has no file.

    ``rest``: type of one more array of any length behind the others."""
    key = (path, name, shard)
    if key not in _OPEN:
        if (root := _local(path)) is not None:
            file = f"{root}/{name}-{shard}.bin"
            data = np.memmap(file, np.uint8, "r") if os.path.exists(file) else None
        else:
            fs, root = pafs.FileSystem.from_uri(path)
            file = f"{root}/{name}-{shard}.bin"
            data = None if fs.get_file_info(file).type == pafs.FileType.NotFound else np.frombuffer(fs.open_input_file(file).read(), np.uint8)
        n = int(data[:8].view(np.int64)[0]) if data is not None else 0
        out, at = [], 8
        for t in types:
            size = n * np.dtype(t).itemsize
            out.append(data[at : at + size].view(t) if n else np.zeros(0, t))
            at += size
        if rest is not None:
            out.append(data[at:].view(rest) if n else np.zeros(0, rest))
        if len(_OPEN) > 4096 or root is None:
            _OPEN.clear()
        _OPEN[key] = out
    return _OPEN[key]


def by_range(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key; ascending with the key, so that the shards in order are sorted as a whole."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def find(path: str, name: str, shard_of: np.ndarray, keys: np.ndarray, types: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """(position in its shard or -1, value arrays) for each key. ``types``: of the keys, then of each value column."""
    order = np.argsort(keys)
    if (np.diff(shard_of[order]) < 0).any():  # shards that are no ranges of keys
        order = np.lexsort((keys, shard_of))
    place = np.full(len(keys), -1, np.int64)
    values = [np.zeros(len(keys), t) for t in types[1:]]
    s = shard_of[order]
    edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else []
    for a, b in zip(edges, [*edges[1:], len(s)]):
        stored, *cols = read_shard(path, name, int(s[a]), types)
        if not len(stored):
            continue
        own = order[a:b]
        at = np.searchsorted(stored, keys[own])
        at[at == len(stored)] = 0
        hit = stored[at] == keys[own]
        place[own[hit]] = at[hit]
        for v, c in zip(values, cols):
            v[own[hit]] = c[at[hit]]
    return place, values


def split(shard_of: np.ndarray, *arrays: np.ndarray):
    """(shard, its part of each array) for arrays that are in the order of the shards."""
    edges = np.flatnonzero(np.r_[True, shard_of[1:] != shard_of[:-1]]) if len(shard_of) else []
    for a, b in zip(edges, [*edges[1:], len(shard_of)]):
        yield int(shard_of[a]), [x[a:b] for x in arrays]
