"""Vectorised byte and word kernels over Arrow string columns, shared by the operators.

All work goes over pieces of a MB, so memory is bounded by the piece (or by
one document where that is longer), not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: The blanks 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``base`` and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, U64)
            while len(p) < n:
                p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """h with h[j] - h[i] = sum of (byte + 1) * base**position over i <= position < j."""
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data), base)[0][: len(data)], out=h[1:])
    return h


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row begins and the last ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``limit`` bytes in all, or of one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, at: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the index of each row's first word (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~gap[data]
    row = np.zeros(n + 1, bool)
    row[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    start = np.flatnonzero(ink & ~(before & ~row[:n]))
    end = np.flatnonzero(ink & ~(after & ~row[1:])) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + PIECE, "right")))
        h = prefix_hash(data[lo : int(end[j - 1])])
        s = start[i:j] - lo
        out[i:j] = (h[end[i:j] - lo] - h[s]) * powers(len(h))[1][s]
        i = j
    return mix64(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each row, sorted, one row after another, and where rows begin.

    A row of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(words)
    factor = mix64(np.arange(1, k + 1, dtype=U64)) | U64(1)
    full = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        full += words[j : n - k + 1 + j] * factor[j]
    full = mix64(full + U64(k))
    out, at = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.unique(full[a : b - k + 1])
        elif b > a:
            s = mix64((words[a:b] * factor[: b - a]).sum(keepdims=True, dtype=U64) + U64(b - a))
        else:
            s = words[:0]
        out.append(s)
        at.append(at[-1] + len(s))
    return np.concatenate(out) if out else words[:0], np.asarray(at, np.int64)


def segment(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    """``ufunc`` reduced over each segment values[at[i]:at[i+1]]; ``empty`` where it has none."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
