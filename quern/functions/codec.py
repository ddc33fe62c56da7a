"""Gaps and variable-byte codes of posting lists: sizes in SQL, bytes in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vbyte_size(value: Column) -> Column:
    """Bytes of a non-negative integer at 7 bits a byte."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(value >= (1 << (7 * k)), 1).otherwise(0)
    return size


def encode(values) -> bytes:
    """Least significant 7 bits first; the last byte of a value has its high bit set."""
    v = np.asarray(values, np.int64)
    if not len(v):
        return b""
    sizes = 1 + sum((v >= (1 << (7 * k))).astype(int) for k in range(1, 9))
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max())):
        live = sizes > k
        out[at[live] + k] = (v[live] >> (7 * k)) & 127
    out[at + sizes - 1] |= 128
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b & 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


def gaps(docs) -> np.ndarray:
    d = np.asarray(docs, np.int64)
    return np.diff(d, prepend=0)


def ungap(values) -> np.ndarray:
    return np.cumsum(np.asarray(values, np.int64))


@F.pandas_udf(T.BinaryType())
def vbyte(lists: pd.Series) -> pd.Series:
    return lists.map(encode)


@F.pandas_udf(T.BinaryType())
def pack(positions: pd.Series) -> pd.Series:
    """Sorted positions as gaps in variable bytes."""
    return positions.map(lambda p: encode(gaps(p)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpack(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: ungap(decode(b)))


def skip_cost(a: list[int], b: list[int], skips: bool) -> tuple[int, int]:
    """(common documents, comparisons) of merging two sorted lists, with or without skips of the square root of their lengths."""
    i = j = common = steps = 0
    leap = [int(len(x) ** 0.5) if skips else 0 for x in (a, b)]
    while i < len(a) and j < len(b):
        steps += 1
        if a[i] == b[j]:
            common, i, j = common + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i, more = _advance(a, i, b[j], leap[0])
            steps += more
        else:
            j, more = _advance(b, j, a[i], leap[1])
            steps += more
    return common, steps


def _advance(x: list[int], i: int, target: int, leap: int) -> tuple[int, int]:
    """The next place in ``x``, by skips that don't pass ``target`` where there are any; and the comparisons made for skips."""
    j, steps = i, 0
    if leap > 1 and i % leap == 0:
        while j + leap < len(x):
            steps += 1
            if x[j + leap] > target:
                break
            j += leap
    return (j if j > i else i + 1), steps
