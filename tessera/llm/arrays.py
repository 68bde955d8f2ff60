"""Vectorised helpers over Arrow string columns: bytes, words, polynomial hashes.

Every helper works on one Arrow batch (or a slice of it), so memory is bounded
by the batch and nothing here depends on which rows share a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a single longer text is still handled whole.
CHUNK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value for each byte value: the letters of polynomial hashes.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: The same for a second, independent hash.
OTHER_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
#: White space that ends a word: space and \t \n \v \f \r, nothing else.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library: its own policy holds
    _libc = None

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


#: How to drop tables that an operator keeps in a worker, which the stages after it don't need.
caches: list[Callable[[], None]] = []


def release() -> None:
    """Drop what other operators keep, and give freed memory back to the system: the workers of an executor share its memory with the JVM."""
    for forget in caches:
        forget()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i below n, kept and grown on demand."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 16)
        for name, base in (("_pow", _BASE), ("_inv", _BASE_INV)):
            x = np.full(size, base & (2**64 - 1), U64)
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=U64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, one longer than values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], dtype=U64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span lies; mixed with its length."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(raw ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one offset more); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    if at is None or data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about size bytes each; a row is never split."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not space; runs end with their row."""
    inside = ~space[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position; empty rows hold none."""
    return np.searchsorted(offsets, positions, "right") - 1


def per_row(n: int, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or count) by row, as int64."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    return np.rint(np.bincount(rows, weights=weights, minlength=n)).astype(np.int64)
