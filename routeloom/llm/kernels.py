"""Vectorised passes over the UTF-8 bytes of many texts at once (numpy only).

A *slab* is a run of whole texts: their bytes end to end and the offsets of the texts.
Spans (words, lines) get a 128-bit digest as two 64-bit numbers: 8 bytes a step are mixed into both, and spans
beyond half a KB go through BLAKE2b.  :func:`classes` calls rows equal only if all their numbers are.
"""

from __future__ import annotations

import ctypes
import hashlib

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that start a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80
_ONE, _TWO = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_LONG = 512
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:  # glibc only
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (for mapInArrow), after which its worker gives back memory: workers live on, idle ones beside those of later stages."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slabs(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes; a longer text is a run of its own.

    Nulls are empty texts.
    """
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every span of the bytes (no span is empty)."""
    left = ends - starts
    one, two = left.astype(U) * _ONE + U(1), left.astype(U) * _TWO + U(2)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for i in np.flatnonzero(left > _LONG).tolist():
        d = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        one[i], two[i] = (U(int.from_bytes(d[k : k + 8], "little")) for k in (0, 8))
    live = np.flatnonzero(left <= _LONG)
    at, left = starts[live], left[live]
    while len(live):
        lane = eight[at].view(U).ravel() & _LOW_BYTES[np.minimum(left, 8)]
        one[live] = mix((one[live] ^ lane) * _ONE)
        two[live] = mix((two[live] + lane) * _TWO + U(5))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return one, two


def classes(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each class, and the class of each row: rows are of one class when they agree in all parts.

    Classes are in order of the first part, if that tells them all apart.
    """
    _, first, which = np.unique(parts[0], return_index=True, return_inverse=True)
    if all((p == p[first][which]).all() for p in parts[1:]):
        return first, which
    order = np.lexsort(parts[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([p[order[1:]] != p[order[:-1]] for p in parts])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of other characters than 0x20 and 0x09-0x0D."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def with_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return mix(keys + doc.astype(U) * U(0xD6E8FEB86659FD93) + U(1))
