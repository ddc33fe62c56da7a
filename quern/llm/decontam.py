"""Benchmark decontamination by pigeonhole pieces and exact edit distance.

Texts are sequences of words (lower-cased; everything but letters, digits and
non-ASCII bytes parts words). Scripts written without blanks (Han, kana, Thai,
Lao, Tibetan, Burmese, Khmer, Yi) have a word a character, and their punctuation
parts words. A document is contaminated by an item of L words if some part of it
is within k = ``MAX_EDIT`` * L word edits of the item, rounded down: items of
fewer than five words must stand there word by word.

1. An item is cut in k + 1 pieces of equal length, up to a word, so five words
   each at most, and two at least unless the item has one word. k edits touch k of them at most, so one piece at least stands
   unchanged in any copy, wherever the edits are and however long the item is.
2. Every word of a document starts a window for each length of pieces; windows
   equal to a piece (by 64-bit hash) give the part of the document in which the
   copy must lie: k words more than the item on both sides.
3. Parts of one item that overlap are joined, and each is verified by exact
   semi-global edit distance. Nothing within the distance is missed.

Items go to the executors in blocks of ``ITEMS_A_BLOCK`` items or
``CHARS_A_BLOCK`` characters, so what a task holds is bounded; documents never shuffle. Whole texts are read.

Defined cases: null texts and texts without words match nothing; an item with a
null id is searched like any other; an item that occurs several times in a
document gives one row, with its least distance and then its first place;
repeated rows give equal rows; equal items each give theirs; empty tables give
an empty result. Only ids and texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .support import small_batches

MAX_EDIT = 0.2
ITEMS_A_BLOCK, CHARS_A_BLOCK = 5000, 4 << 20
FILTER_BITS = 20
#: Hits of pieces that are looked at together.
HITS_AT_ONCE = 1 << 20

#: What parts words: all of ASCII but letters and digits.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


#: Characters that are words, and characters that part words, as ranges of code points.
SOLO = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FFF), (0x3005, 0x3007), (0x3021, 0x312F), (0x3190, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
PARTING = ((0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def within(code: np.ndarray, ranges: tuple) -> np.ndarray:
    """Whether each code point is in one of the ascending ``ranges``."""
    at = np.searchsorted(np.array([lo for lo, _ in ranges]), code, "right") - 1
    return (at >= 0) & (code <= np.array([hi for _, hi in ranges])[at])


def unspaced(low: np.ndarray) -> np.ndarray:
    """Blanks out what parts words beyond ASCII, and returns where words of one character begin and end, in order."""
    lead = np.flatnonzero(low >= 0xE0)
    if not len(lead):
        return lead
    long = (low[lead] >= 0xF0).astype(np.int64)
    byte = [np.take(low, lead + i, mode="clip").astype(np.int64) for i in range(4)]
    code = (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63
    code = np.where(long, code << 6 | byte[3] & 63, code)
    gone = lead[within(code, PARTING)]
    for i in range(3):
        low[gone + i] = 0x20
    solo = within(code, SOLO)
    return np.unique(np.concatenate([lead[solo], (lead + 3 + long)[solo]]))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows (never 0), and the index of each row's first word."""
    low = K.LOWER[data]
    cuts = unspaced(low)
    start, end, first = K.word_bounds(low, np.union1d(at, cuts) if len(cuts) else at, GAP)
    return K.word_hashes(low, start, end) | K.U64(1), np.searchsorted(start, at) if len(cuts) else first


def edits(length: int) -> int:
    return int(MAX_EDIT * length + 1e-9)


def alignment(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends (bit-parallel)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | ~(zero | up) & full, up & zero
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | ~(zero | hp) & full, hp & zero
        if score < best:
            best, at = score, j
    return best, at


class Items:
    """A block of items with their pieces by length."""

    def __init__(self, ids: list, texts: list):
        data, at = K.string_bytes(pa.array(texts, pa.string()))
        hashes, first = words(data, at)
        every = [(i, hashes[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True)]
        self.items = [(i, w) for i, w in every if len(w)]
        self.lists = [w.tolist() for _, w in self.items]
        self.sets = [set(w) for w in self.lists]
        self.sizes = np.array([len(w) for w in self.lists], np.int64)
        self.edits = np.array([edits(len(w)) for w in self.lists], np.int64)
        found: dict[int, list] = {}
        for n, (_, w) in enumerate(self.items):
            cuts = [len(w) * i // (edits(len(w)) + 1) for i in range(edits(len(w)) + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found.setdefault(b - a, []).append((n, a, w[a:b]))
        #: (length, filter of low bits, sorted keys of the pieces, their items and places in these)
        self.pieces = []
        for size, rows in sorted(found.items()):
            keys = np.concatenate([window_keys(w, (size,))[size] for _, _, w in rows])
            order = np.argsort(keys, kind="stable")
            there = np.zeros(1 << FILTER_BITS, bool)
            there[low_bits(keys)] = True
            self.pieces.append((size, there, keys[order], np.array([(n, a) for n, a, _ in rows], np.int64)[order]))


def low_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & K.U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def window_keys(hashes: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, the keys of the windows that start at each word (without regard to where rows end)."""
    factor = K.mix64(np.arange(1, max(lengths, default=0) + 1, dtype=K.U64)) | K.U64(1)
    sums, out = np.zeros(len(hashes), K.U64), {}
    for j in range(min(max(lengths, default=0), len(hashes))):
        sums = sums[: len(hashes) - j] + hashes[j:] * factor[j]
        if j + 1 in lengths:
            out[j + 1] = K.mix64(sums + K.U64(j + 1))
    return out


def hits(items: Items, hashes: np.ndarray, first: np.ndarray):
    """Arrays (row, item, word of the row's text where the item would start), some at a time: each window equal to a piece."""
    keys = window_keys(hashes, tuple(size for size, *_ in items.pieces))
    for size, there, pieces, owners in items.pieces:
        if size not in keys:
            continue
        at = np.flatnonzero(there[low_bits(keys[size])])
        key = keys[size][at]
        a, b = np.searchsorted(pieces, key, "left"), np.searchsorted(pieces, key, "right")
        row = np.searchsorted(first, at, "right") - 1
        real = (b > a) & (at + size <= first[row + 1])
        at, row, a, times = at[real], row[real], a[real], (b - a)[real]
        ends = np.cumsum(times)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS_AT_ONCE, "right")))
            n = times[i:j]
            which = np.repeat(a[i:j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item, before = owners[which].T
            yield np.repeat(row[i:j], n), item, np.repeat(at[i:j], n) - before
            i = j


def parts(items: Items, hashes: np.ndarray, first: np.ndarray):
    """Rows (row, item, lo, hi): the parts of the text, joined where they overlap, outside of which the item has no copy."""
    for row, item, start in hits(items, hashes, first):
        k = items.edits[item]
        lo, hi = np.maximum(first[row], start - k), np.minimum(first[row + 1], start + items.sizes[item] + k)
        order = np.lexsort((lo, item, row))
        row, item, lo, hi = row[order], item[order], lo[order], hi[order]
        # Both bounds rise together, so the part before is the one that reaches furthest.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        begin = np.flatnonzero(new)
        last = np.concatenate([begin[1:], [len(row)]]) - 1
        yield from zip(row[begin].tolist(), item[begin].tolist(), lo[begin].tolist(), hi[last].tolist(), strict=True)


def matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, word after its end) of every item found in a row."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for row, item, lo, hi in parts(items, hashes, first):
        k = edits(len(items.lists[item]))
        part = hashes[lo:hi].tolist()
        # Each word of the item without an equal in the document costs an edit.
        if len(items.sets[item].difference(part)) > k:
            continue
        distance, at = alignment(items.lists[item], part)
        if distance <= k:
            got = (distance, lo + at - int(first[row]))
            have = best.get((row, item))
            if not have or got < have:
                best[row, item] = got
    return [(row, item, d, e) for (row, item), (d, e) in sorted(best.items())]


def _scan(items: Items, at_once=K.PIECE):
    for_block = items

    def per_batch(column):
        data, at = K.string_bytes(column)
        for i, j in K.pieces(at, at_once):
            hashes, first = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for row, item, d, e in matches(for_block, hashes, first):
                yield i + row, item, d, e

    return per_batch


def _blocks(benchmark: DataFrame, key: str):
    """Items in blocks; the driver holds one block's texts at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(key, "text").where(F.col("text").isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if len(ids) == ITEMS_A_BLOCK or size >= CHARS_A_BLOCK:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, distance, item_words, end_word): the items found in each document."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, item_words int, end_word int"
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark.select(F.col("item_id").cast("long"), "text"), "item_id"):

        def run(batches, items=items):
            per_batch = _scan(items)
            for batch in batches:
                found = list(per_batch(batch.column(1)))
                rows, which, d, e = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([items.items[w][0] for w in which], pa.int64()),
                        pa.array(d, pa.int32()),
                        pa.array([len(items.lists[w]) for w in which], pa.int32()),
                        pa.array(e, pa.int32()),
                    ],
                    ["doc_id", "item_id", "distance", "item_words", "end_word"],
                )

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for items in _blocks(benchmark.select(F.col("item_id").cast("long"), "text"), "item_id"):

        def run(batches, items=items):
            per_batch = _scan(items)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, *_ in per_batch(batch.column(at)):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
