"""Vectorised byte kernels shared by the text operators (run inside Spark tasks).

Texts arrive as Arrow string columns. A column is cut into chunks of whole
documents holding about ``CHUNK_BYTES`` bytes (a longer document is its own
chunk), so a task's memory is bounded by one chunk or one document. Nulls
have length zero, exactly like empty texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10
U64 = np.uint64

#: Bytes that end a word: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def freed(results: Iterator) -> Iterator:
    """``results`` of a task; at its end the worker's free memory goes back to the system. Workers wait for their
    next task beside the executor's heap, and the C allocator would keep what their largest chunk took."""
    try:
        yield from results
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 (arithmetic modulo 2**64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# One random odd-ish value per byte; upper-case A-Z hash like their lower-case letters.
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]
_BASE = 0x2545F4914F6CDD1D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.array([1], dtype=U64)
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; document i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents."""
    data, off = text_bytes(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte value times base**position; spans are read off with ``span_hash``."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_VALUES[data] * _power_table(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, independent of where the span lies."""
    shift = _power_table(_BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * shift[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of non-separator bytes within a document."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word, A-Z lower-cased."""
    s, e, d = word_spans(data, off, separators)
    if not len(s):
        return np.zeros(0, U64), d
    return span_hash(prefix_hash(data), s, e), d


def ngram_hashes(words: np.ndarray, doc: np.ndarray, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of n consecutive words; ``skip`` leaves out that many words after the first."""
    reach = n + skip
    if len(words) < reach:
        return np.zeros(0, U64), np.zeros(0, doc.dtype)
    last = len(words) - reach + 1
    h = mix(words[:last] + U64(n * 31 + skip))
    for k in range(1, n):
        h = mix(h * U64(0x9FB21C651E98DF25) + words[k + skip:k + skip + last])
    same = doc[:last] == doc[reach - 1:]
    return h[same], doc[:last][same]
