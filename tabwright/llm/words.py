"""Words and their 64-bit hashes for whole batches of texts, with numpy only.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z. The bytes of many texts are handled at once: every span
of bytes is hashed eight bytes after the other, all spans of that length together, so the cost is a few
array passes and there is no Python work for a word or a text (but for one call for each span over LONG).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once: bounds memory at about 20 bytes for each of them. No word is ever cut.
CHUNK = 1 << 20
#: Bytes of text for which a caller holds the words at once (a longer single text is a slice of its own).
SLICE = 1 << 22

#: Spans of more bytes are hashed one by one, so that a single long one costs no pass for each eight bytes.
LONG = 256
_SEED = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that high and low bits are equally usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes ``data[s[i]:e[i]]``. Each block is mixed in before the next, so no arrangement of equal blocks cancels out."""
    n = e - s
    out = mix(n.astype(np.uint64) + _SEED)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live, at = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        block = eight[s[live] + at] & _MASK[np.minimum(n[live] - at, 8)]
        out[live] = mix(out[live] * _SEED ^ block)
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]], digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and at the end) for texts ``data[offsets[i]:offsets[i+1]]``."""
    hashes, begins = [], []
    at, n = int(offsets[0]), int(offsets[-1])
    edges = offsets[1:-1]
    while at < n:
        stop = min(at + CHUNK, n)
        if stop < n:
            stop = _cut(data, edges, at, stop, n)
        piece = data[at:stop]
        inside = ~_SPACE[piece]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        own = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, stop, "left")] - at
        before[own] = False
        after[own - 1] = False
        s = np.flatnonzero(inside & ~before)
        e = np.flatnonzero(inside & ~after) + 1
        if len(s):
            hashes.append(hash_spans(LOWER[piece], s, e))
            begins.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(b, offsets)


def _cut(data: np.ndarray, edges: np.ndarray, at: int, stop: int, n: int) -> int:
    """A place near ``stop`` that lies in no word: behind a space or between two texts."""
    spaces = np.flatnonzero(_SPACE[data[at:stop]])
    k = np.searchsorted(edges, stop, "right")
    edge = int(edges[k - 1]) if k and edges[k - 1] > at else at
    best = max(edge, at + int(spaces[-1]) + 1 if len(spaces) else at)
    if best > at:
        return best
    nxt = int(edges[k]) if k < len(edges) else n
    while stop < nxt:
        spaces = np.flatnonzero(_SPACE[data[stop : min(stop + CHUNK, nxt)]])
        if len(spaces):
            return stop + int(spaces[0]) + 1
        stop = min(stop + CHUNK, nxt)
    return nxt


def release() -> None:
    """Give memory that is no longer used back to the system: workers live on after a task and share a machine."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a text column, about ``limit`` bytes at a time; null counts as empty."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each word; the last n - 1 of them run past the end and are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(out)


def hash_texts(column: pa.Array) -> np.ndarray:
    """64-bit hash of each text as it is."""
    out = np.zeros(len(column), np.uint64)
    for first, stop, data, offsets in slices(column, CHUNK):
        out[first:stop] = hash_spans(data, offsets[:-1], offsets[1:])
    return out
