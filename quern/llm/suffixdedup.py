"""Exact repeated-substring removal with a logarithmic family of sparse suffix arrays.

A byte goes if a ``length``-byte string covers it that also starts anywhere else.

1. Sparse suffixes. Every ``length``-byte window elects the least of the
   ``GRAM``-byte grams inside it (least hash, leftmost on ties). The elected
   places, about one in (length - GRAM) / 2 bytes, are the suffixes kept.
   Equal windows elect the same gram at the same offset, so two equal windows
   always meet at a kept suffix. Each suffix stands for the run of windows that
   elected it: ``h`` is its gram's hash, ``c`` a second hash of all the bytes
   of its windows with their offset.
2. Levels (:class:`LevelIndex`). Documents come in batches. A batch's suffix
   array has its suffixes in alphabetical order (of their first 16 bytes; equal
   ones by ``h``, then ``c``), equal (h, c) as one entry with their number, in
   shards. A new array is merge-scanned against itself and every level: an
   (h, c) met twice is a long match; an h met with several c is a partial one.
   The scan writes these marks. Then two levels of equal rank merge to one of
   the next, so an entry is rewritten at most log2(batches) times. Levels,
   marks and suffixes are tables below one folder with a manifest: an index can
   be closed, opened elsewhere, and be added to.
3. Long matches. Marked (h, c): all windows of these suffixes repeat. Marked h:
   the suffixes agree in their gram but not in all of their windows (near
   copies, common passages). For one suffix of each of their (h, c), its
   windows are split in runs of ``RUN`` by their distance from the gram; a
   run's core is what all its windows share. Runs are matched like suffixes, by
   core and by all bytes, and only of runs that share a core but not all bytes
   are the windows themselves fingerprinted and counted by (h, fingerprint).
   All keys are hashes of longer and longer strings, so the hottest passage
   spreads over all tasks.
4. The windows that repeat are laid over their documents and merged to spans.

Shorter matches are reported and not removed: ``n_passages`` counts a
document's kept suffixes around which ``PASSAGE`` bytes also stand elsewhere. A
passage of over 50 words that is too short for a whole window is seen this way,
if its least gram is kept in both places (most are; see the README).

Documents without a repeat never leave their scan but for ids and digests; the
texts of the others are found by a fixed-size key filter and a join.

Defined cases: null text is empty; a text shorter than ``length`` loses
nothing; a row that repeats another one, id included, repeats all of its
windows; a null ``doc_id`` is a row like any other; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .support import Scratch, key_filter

LENGTH, GRAM, RUN, BATCHES = 400, 64, 32, 4
#: Bytes of a passage that is reported, and the distances between the places at which it may lie around a gram.
PASSAGE, STEP = 224, 32
#: Bytes hashed at a time; a gram's place must fit in the low bits of its rank.
SEGMENT_BITS = 20
OTHER_BASE = 0xD1342543DE82EF95


def segments(at: np.ndarray, length: int):
    """Ranges of bytes of at most a segment: (rows i to j, first byte, last). Longer rows come in overlapping parts."""
    limit = 1 << SEGMENT_BITS
    for i, j in K.pieces(at, limit):
        lo, hi = int(at[i]), int(at[j])
        while hi - lo > limit:
            yield i, j, lo, lo + limit
            lo += limit - (length - 1)
        yield i, j, lo, hi


def suffixes(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Arrays (row, at, h, c, head, next) of the kept suffixes; ``at`` packs the first window (from the
    row's first byte), the number of windows, and the gram's distance from the first window;
    ``head`` and ``next`` are the suffix's first 16 bytes as integers in alphabetical order."""
    found = []
    shift = K.U64(SEGMENT_BITS)
    for i, j, lo, hi in segments(at, length):
        n = hi - lo
        if n < length:
            continue
        part = data[lo:hi]
        h1, h2 = K.prefix_hash(part), K.prefix_hash(part, OTHER_BASE)
        m = n - gram + 1
        g = K.mix64((h1[gram:] - h1[:-gram]) * K.powers(m)[1][:m])
        rank = (g >> shift << shift) | np.arange(m, dtype=K.U64)
        width, size = length - gram + 1, 1
        while size * 2 <= width:
            rank = np.minimum(rank[:-size], rank[size:])
            size *= 2
        if width > size:
            rank = np.minimum(rank[: size - width], rank[width - size :])
        place = (rank & K.U64((1 << SEGMENT_BITS) - 1)).astype(np.int64)
        # Windows that lie in one row.
        edge = np.zeros(len(place) + 1, np.int32)
        rows = np.clip(at[i : j + 1] - lo, 0, n)
        ok = rows[1:] - rows[:-1] >= length
        np.add.at(edge, rows[:-1][ok], 1)
        np.add.at(edge, rows[1:][ok] - length + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = np.empty(len(place), bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        row_starts = rows[:-1][ok]
        new[row_starts] = True
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
        a, b = first, stop + length - 1
        offset = place[first] - first
        c = (h2[b] - h2[a]) * K.powers(n + 1, OTHER_BASE)[1][a]
        c = K.mix64(c + offset.astype(K.U64) * K.U64(0x9FB21C651E98DF25) + (stop - first).astype(K.U64) * K.U64(0xA24BAED4963EE407))
        row = np.searchsorted(at, first + lo, "right") - 1
        found.append((row, (first + lo - at[row]) << 18 | (stop - first) << 9 | offset, g[place[first]], c, *heads(part, place[first])))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z.view(K.U64), z.view(K.U64), z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def heads(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes at each place as two integers whose order is that of the bytes."""
    out = []
    for lo in (0, 8):
        v = np.zeros(len(place), K.U64)
        for i in range(lo, lo + 8):
            v = v << K.U64(8) | data[place + i].astype(K.U64)
        out.append(K.signed(v ^ K.U64(1 << 63)))
    return out[0], out[1]


def window_prints(data: np.ndarray, start: int, windows: int, length: int = LENGTH) -> np.ndarray:
    """Fingerprints of ``windows`` consecutive windows of ``data`` from ``start``."""
    h = K.prefix_hash(data[start : start + windows + length - 1], OTHER_BASE)
    return K.mix64((h[length:] - h[:-length]) * K.powers(len(h), OTHER_BASE)[1][:windows])


def window_runs(data: np.ndarray, start: int, windows: int, offset: int, length: int = LENGTH):
    """Arrays (q, first window, windows, core, full) of a suffix's runs: windows that begin q * RUN to q * RUN + RUN - 1 bytes before its gram."""
    lo, place = start, start + offset
    q = np.arange((offset - windows + 1) // RUN, offset // RUN + 1)
    first = np.maximum(place - q * RUN - RUN + 1, start)
    last = np.minimum(place - q * RUN, start + windows - 1)
    h = K.prefix_hash(data[lo : start + windows + length - 1], OTHER_BASE)
    inverse = K.powers(len(h), OTHER_BASE)[1]
    a, b = place - q * RUN - lo, place - q * RUN - RUN + 1 + length - lo
    core = K.mix64((h[b] - h[a]) * inverse[a])
    full = K.mix64((h[last + length - lo] - h[first - lo]) * inverse[first - lo] + ((place - first) << 9 | (last - first)).astype(K.U64))
    return q, first, last - first + 1, core, full


def passage_prints(data: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance to the gram at ``place``, fingerprint) of the strings of ``PASSAGE`` bytes around a gram."""
    begin = place - np.arange(0, PASSAGE - GRAM + 1, STEP)
    begin = begin[(begin >= 0) & (begin + PASSAGE <= len(data))]
    if not len(begin):
        return begin, begin.view(K.U64)
    lo = int(begin[-1])
    h = K.prefix_hash(data[lo : int(begin[0]) + PASSAGE], OTHER_BASE)
    at = begin - lo
    return place - begin, K.mix64((h[at + PASSAGE] - h[at]) * K.powers(len(h), OTHER_BASE)[1][at])


def _suffixes(length: int, gram: int):
    def run(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(1))
            row, place, h, c, head, following = suffixes(data, at, length, gram)
            cols = [batch.column(0).take(pa.array(row)), pa.array(place), pa.array(K.signed(h)), pa.array(K.signed(c)), pa.array(head), pa.array(following)]
            yield pa.RecordBatch.from_arrays(cols, ["dkey", "at", "h", "c", "head", "next"])

    return run


#: ``q`` of a passage: this less its distance to the gram.
PASSAGES = -1000


def _runs(length: int):
    """(dkey, text, entries of (at, h, n)) to (h, q, core, c, n, dkey, at) of the entries' runs, and of passages around their grams."""

    def run(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(1))
            keys, out = batch.column(0).to_pylist(), []
            for i, entries in enumerate(batch.column(2).to_pylist()):
                own = data[at[i] : at[i + 1]]
                for e in entries:
                    start, many, offset = e["at"] >> 18, e["at"] >> 9 & 511, e["at"] & 511
                    q, first, windows, core, full = window_runs(own, start, many, offset, length)
                    k = len(q)
                    out.append((np.full(k, e["h"]), q, K.signed(core), K.signed(full), np.full(k, e["n"]), np.full(k, keys[i]), first << 18 | windows << 9))
                    if e["n"] == 1:
                        away, prints = passage_prints(own, start + offset)
                        k = len(away)
                        out.append((np.full(k, e["h"]), PASSAGES - away, K.signed(prints), K.signed(prints), np.ones(k, np.int64), np.full(k, keys[i]), np.full(k, e["at"])))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["h", "q", "core", "c", "n", "dkey", "at"])

    return run


def _prints(length: int):
    """(dkey, text, entries of (at, h, n)) to (h, f, n, dkey, w): fingerprints of the entries' windows."""

    def run(batches):
        for batch in batches:
            data, at = K.string_bytes(batch.column(1))
            keys, out = batch.column(0).to_pylist(), []
            for i, entries in enumerate(batch.column(2).to_pylist()):
                own = data[at[i] : at[i + 1]]
                for e in entries:
                    start, k = e["at"] >> 18, e["at"] >> 9 & 511
                    out.append((np.full(k, e["h"]), K.signed(window_prints(own, start, k, length)), np.full(k, e["n"]), np.full(k, keys[i]), start + np.arange(k)))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "f", "n", "dkey", "w"])

    return run


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removals(batches):
    for batch in batches:
        data, at = K.string_bytes(batch.column(1))
        keys, removed, runs, digest, lists = batch.column(0), [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            own = data[at[i] : at[i + 1]]
            spans = merged_spans([(s["a"], s["b"]) for s in spans])
            sha, last = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(own[last:a].tobytes())
                last = b
            sha.update(own[last:].tobytes())
            removed.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            digest.append(sha.hexdigest())
            lists.append([{"a": a, "b": b} for a, b in spans])
        span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        yield pa.RecordBatch.from_arrays([keys, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(lists, pa.list_(span))], ["dkey", "n_removed", "n_spans", "sha", "spans"])


def classes(entries: DataFrame, *key: str) -> DataFrame:
    """Entries with equal key and bytes as one row, with their number and one of their places."""
    return entries.groupBy(*key, "c").agg(F.sum("n").alias("n"), F.first("dkey").alias("dkey"), F.first("at").alias("at"))


def contested(scratch: Scratch, level: DataFrame, *key: str) -> DataFrame:
    """Classes that share their key with others.

    The keys are written first: a join of two plain exchanges can split a hot key, one onto an aggregate can't.
    """
    keys = level.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return level.join(scratch.save(keys), [*key], "left_semi")


ENTRY = "dkey long, at long, h long, c long, head long, next long"
ARRAY = "h long, c long, n long, dkey long, at long, head long, next long"
MARK = "h long, c long"


class LevelIndex:
    """Suffix arrays by rank below one folder; two of a rank merge to one of the next.

    A batch is added whole or not at all: the manifest, written last, names the
    tables that count.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, length: int = LENGTH, gram: int = GRAM):
        self.scratch = Scratch(spark, "suffixes", root)
        self.spark, self.length, self.gram = spark, length, gram
        self.levels: dict[int, str] = {}
        self.entries: list[str] = []
        self.marks: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LevelIndex:
        """The index that was written below ``root``."""
        newest = spark.read.json(f"{root}/manifest").orderBy(F.desc("version")).first()
        kept = json.loads(newest["tables"])
        index = cls(spark, root, kept["length"], kept["gram"])
        index.levels = {int(k): v for k, v in kept["levels"].items()}
        index.entries, index.marks = kept["entries"], kept["marks"]
        return index

    def _commit(self) -> None:
        kept = {"length": self.length, "gram": self.gram, "levels": self.levels, "entries": self.entries, "marks": self.marks}
        row = self.spark.range(1).select(F.lit(len(self.entries)).alias("version"), F.lit(json.dumps(kept)).alias("tables"))
        row.coalesce(1).write.mode("append").json(f"{self.scratch.root}/manifest")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _array(self, entries: DataFrame) -> str:
        """Writes the suffix array of ``entries`` and returns its place."""
        one = entries.groupBy("h", "c").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("dkey", "at", "head", "next")])
        return self.scratch.path_of(self.scratch.save(one.sortWithinPartitions("head", "next", "h", "c")))

    def _scan(self, new: str) -> str:
        """Marks of a new array met by itself and the levels: (h, c) of long matches, (h, null) of partial ones."""
        both = self._read([new], ARRAY).select("h", "c", "n", F.lit(True).alias("new"))
        for path in self.levels.values():
            both = both.unionByName(self._read([path], ARRAY).select("h", "c", "n", F.lit(False).alias("new")))
        met = both.groupBy("h", "c").agg(F.sum("n").alias("n"), F.max("new").alias("new"))
        twice = met.where("new and n > 1").select("h", "c")
        alike = met.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("new").alias("new")).where("new and lo < hi")
        return self.scratch.path_of(self.scratch.save(twice.unionByName(alike.select("h", F.lit(None).cast("long").alias("c")))))

    def add(self, entries: str) -> None:
        """A batch of suffixes, written at ``entries``, becomes a level of rank 0, and merges upwards."""
        rows = self._read([entries], ENTRY)
        level, rank, old = self._array(rows.withColumn("n", F.lit(1).cast("long"))), 0, []
        self.marks.append(self._scan(level))
        while rank in self.levels:
            old += [self.levels.pop(rank), level]
            level, rank = self._array(self._read(old[-2:], ARRAY)), rank + 1
        self.levels[rank] = level
        self.entries.append(entries)
        self._commit()
        for path in old:
            self.scratch.drop_path(path)
        self.scratch.release()

    def add_documents(self, keyed: DataFrame, batches: int = 1) -> None:
        """The suffixes of ``keyed(dkey, text)``, in ``batches`` batches."""
        kept = keyed.where(F.octet_length("text") >= self.length).select("dkey", "text").mapInArrow(_suffixes(self.length, self.gram), ENTRY)
        parts = self.scratch.path_of(self.scratch.save(kept.withColumn("batch", F.pmod(F.xxhash64("dkey"), F.lit(batches)).cast("int")), by="batch"))
        have = {r["batch"] for r in self.spark.read.schema(ENTRY + ", batch int").parquet(parts).select("batch").distinct().collect()}  # ``batches`` rows at most
        for b in sorted(have):
            self.add(f"{parts}/batch={b}")

    def suffixes(self) -> DataFrame:
        return self._read(self.entries, ENTRY)

    def array(self) -> DataFrame:
        """All levels as rows (h, c, n, dkey, at); an (h, c) of several levels has a row in each."""
        return self._read(list(self.levels.values()), ARRAY).select("h", "c", "n", "dkey", "at")

    def long_matches(self) -> DataFrame:
        """(h, c) of suffixes all of whose windows repeat."""
        return self._read(self.marks, MARK).where("c is not null").distinct()

    def partial_matches(self) -> DataFrame:
        """(h) of suffixes that agree in their gram, but not in all windows."""
        return self._read(self.marks, MARK).where("c is null").select("h").distinct()


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, dkey, text); ``dkey`` is a hash of id and text, so equal rows share it."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dkey"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spans_of(index: LevelIndex, keyed: DataFrame, repeats: bool) -> tuple[DataFrame, DataFrame]:
    """(removals, passages) of the index's documents, whose texts are ``keyed(dkey, text)``:
    (dkey, n_removed, n_spans, sha, spans of bytes [a, b)) of those that lose bytes, (dkey, n_passages) of those that share any."""
    scratch, length = index.scratch, index.length

    def with_texts(entries: DataFrame, collected: str) -> DataFrame:
        by_doc = entries.groupBy("dkey").agg(F.expr(collected).alias("entries"))
        texts = keyed.where(key_filter(by_doc, "dkey")).select("dkey", "text")
        if repeats:
            texts = texts.dropDuplicates(["dkey"])
        return texts.join(by_doc, "dkey").select("dkey", "text", "entries")

    entry = "collect_list(struct(at, h, n))"
    first, many = F.shiftright("at", 18), F.shiftright("at", 9).bitwiseAND(F.lit(511))
    span = ("dkey", first.alias("a"), (first + many + (length - 1)).alias("b"))
    twice, alike = scratch.save(index.long_matches()), scratch.save(index.partial_matches())
    matched = scratch.save(index.suffixes().select("dkey", "at", "h", "c").join(twice, ["h", "c"], "left_semi").select("dkey", "at"))
    whole = matched.select(*span)

    some = scratch.save(index.array().join(alike, "h", "left_semi"))
    some = classes(some, "h") if len(index.levels) > 1 else some
    runs = scratch.save(with_texts(some, entry).mapInArrow(_runs(length), "h long, q long, core long, c long, n long, dkey long, at long"))
    key = ("h", "q", "core")
    level = scratch.save(classes(runs, *key))
    again = scratch.save(level.where("n > 1").select(*key, "c"))
    met = runs.join(again, [*key, "c"], "left_semi")
    whole = whole.unionByName(met.where(F.col("q") > PASSAGES).select(*span))
    shared = matched.unionByName(met.where(F.col("q") <= PASSAGES).select("dkey", "at").distinct())
    shared = shared.groupBy("dkey").agg(F.count("*").alias("n_passages"))

    prints = with_texts(contested(scratch, level.where(F.col("q") > PASSAGES), *key), entry).mapInArrow(_prints(length), "h long, f long, n long, dkey long, w long")
    prints = scratch.save(prints)
    equal = prints.groupBy("h", "f").agg(F.sum("n").alias("t")).where("t > 1").select("h", "f")
    lone = prints.where("n = 1").join(scratch.save(equal), ["h", "f"], "left_semi")
    whole = whole.unionByName(lone.select("dkey", F.col("w").alias("a"), (F.col("w") + length).alias("b")))

    spans = scratch.save(whole.distinct())
    removals = with_texts(spans, "collect_list(struct(a, b))").mapInArrow(_removals, "dkey long, n_removed long, n_spans long, sha string, spans array<struct<a:long,b:long>>")
    return scratch.save(removals), scratch.save(shared)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, index: LevelIndex | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, spans (of bytes removed).

    With an ``index`` that was made before, ``docs`` must hold the documents in it and those that are new.
    """
    new = index is None
    index = LevelIndex(docs.sparkSession, None, length, gram) if new else index
    scratch, keyed = index.scratch, keyed_texts(docs)
    rows = scratch.save(keyed.select("doc_id", "dkey", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    if new:
        index.add_documents(keyed, batches)
    repeats = bool(rows.groupBy("dkey").count().where("count > 1").limit(1).count())
    gone, shared = spans_of(index, keyed, repeats)
    out = rows.join(gone.withColumnRenamed("sha", "left_sha"), "dkey", "left").join(shared, "dkey", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("left_sha", "sha").alias("kept_sha256"), F.coalesce("n_passages", zero).alias("n_passages"), "spans",
    )
