"""Vectorised words of UTF-8 texts: ASCII lower-casing, ASCII white space, a 64-bit hash for each word.

A word's hash depends on its bytes alone, so every process and run agrees on it. Its six highest
bits depend on the first and last byte only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
PIECE_BYTES = 1 << 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n + 1, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    low = LOWER[data]
    word = ~SPACE[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[low] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    kind = (low[start] * U64(5) + low[end - 1] * U64(11)) & U64(63)
    return h >> U64(6) | kind << U64(58), start, end, low


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some rows in order, and where each row's words begin."""
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    bounds = offsets - base
    if n <= PIECE_BYTES:
        h, start, _, _ = _hashed(data[base : base + n], bounds)
        return h, np.searchsorted(start, bounds)
    parts, counts = [], [0]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        made = 0
        while lo < hi:
            cut = int(min(lo + PIECE_BYTES, hi))
            while cut < hi and not SPACE[data[base + cut]]:
                cut += 1
            h = _hashed(data[base + lo : base + cut], np.array([0, cut - lo]))[0]
            parts.append(h)
            made += len(h)
            lo = cut
        counts.append(counts[-1] + made)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.array(counts)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of `size` words; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * U64(0xC2B2AE3D27D4EB4F) + h[k : k + n])
    return np.unique(out)
