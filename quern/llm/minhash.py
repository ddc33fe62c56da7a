"""MinHash near-duplicates by a multi-index Hamming join.

1. Every document gets the set of its distinct k-word shingles (hashes), a
   128-bit digest of the set, and a signature of 4m symbols: 16 bits of the
   least value under each of 4m hash functions. Documents with equal digests
   form a class; from here on each class is one row.
2. A pair with Jaccard J differs in a Binomial(4m, 1 - J) number of symbols. m
   is the least number of chunks for which a pair at the threshold differs in
   more than 2m - 1 symbols with probability ``MISS`` at most.
3. The signature is split in m chunks of 4 symbols. Two signatures that differ
   in 2m - 1 symbols at most have, by pigeonhole, a chunk that differs in one
   symbol at most. All places of that error are enumerated: a chunk's 4 keys
   each leave out one symbol. So every pair under the distance threshold shares
   a key.
4. Inside a bucket (rows of one key) not all pairs are formed. Each row is
   compared with the bucket's hub, the row with the most collisions; confirmed
   links give components; then only rows that are still in different
   components are paired. A pair left out joins rows already connected, so the
   components are those of all pairs.
5. A pair comes out of its bucket only if its sets can reach the threshold.
   That is told without loss by their sizes and by odd sketches: each shingle
   flips one of ``ODD_BITS`` bits, so sketches differ in no more bits than the
   sets differ in shingles. Of the buckets that a pair shares, only the first
   gives it.
6. A pair is confirmed on its full shingle sets.

Defined cases: text is lower-cased over A-Z, and words are what the blanks
0x20 and 0x09-0x0D part; null or wordless text has an empty set, links with
nothing and is its own component; fewer than k words make one shingle; a row
with a null ``doc_id`` gets a null component and is kept; rows that repeat a
``doc_id`` are one node; an empty table gives an empty result. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .support import Scratch, components

MISS = 1e-4
ODD_WORDS = 16
ODD_BITS = 64 * ODD_WORDS


def chunks_for(percent: int, miss: float = MISS) -> int:
    """Least m for which P(Binomial(4m, 1 - percent/100) > 2m - 1) <= miss."""
    p = 1 - percent / 100
    for m in range(1, 65):
        n = 4 * m
        if sum(comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(2 * m, n + 1)) <= miss:
            return m
    raise ValueError("the threshold is too low for this signature")


def _pieces(column):
    data, at = K.string_bytes(column)
    for i, j in K.pieces(at):
        own = at[i : j + 1] - at[i]
        low = K.LOWER[data[at[i] : at[j]]]
        start, end, first = K.word_bounds(low, own)
        yield i, j, K.word_hashes(low, start, end), first


def digests(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (
        K.segment(np.add, K.mix64(sets), at, 0),
        K.segment(np.bitwise_xor, K.mix64(sets ^ K.U64(0x5851F42D4C957F2D)), at, 0),
    )


def signatures(sets: np.ndarray, at: np.ndarray, m: int) -> list[np.ndarray]:
    """m words of four 16-bit symbols for each row."""
    factor = K.mix64(np.arange(1000, 1000 + 4 * m, dtype=K.U64)) | K.U64(1)
    words = []
    for c in range(m):
        word = np.zeros(len(at) - 1, K.U64)
        for w in range(4):
            f = factor[4 * c + w]
            least = K.segment(np.minimum, (sets ^ (f >> K.U64(7))) * f, at, 0)
            word |= (K.mix64(least) & K.U64(0xFFFF)) << K.U64(16 * w)
        words.append(word)
    return words


def odd_sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ODD_WORDS words for each row; bit b is the parity of the number of shingles that hash to b."""
    n, rows = len(at) - 1, 1024
    out = np.zeros((n, ODD_WORDS), np.uint64)
    bit = (K.mix64(sets ^ K.U64(0x2545F4914F6CDD1D)) & K.U64(ODD_BITS - 1)).astype(np.int64)
    for lo in range(0, n, rows):
        hi = min(n, lo + rows)
        owner = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        odd = np.bincount(owner * ODD_BITS + bit[at[lo] : at[hi]], minlength=(hi - lo) * ODD_BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(bool), bitorder="little").view(np.uint64).reshape(hi - lo, ODD_WORDS)
    return out


def columns(m: int) -> list[str]:
    return [f"s{i}" for i in range(m)] + [f"o{i}" for i in range(ODD_WORDS)]


def _sketches(k: int, m: int):
    def run(batches):
        for batch in batches:
            for i, j, words, first in _pieces(batch.column(1)):
                sets, at = K.shingles(words, first, k)
                c1, c2 = digests(sets, at)
                sig = signatures(sets, at, m)
                odd = odd_sketches(sets, at)
                sig += [np.ascontiguousarray(odd[:, x]) for x in range(ODD_WORDS)]
                cols = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(K.signed(c1)), pa.array(K.signed(c2)), *[pa.array(K.signed(s)) for s in sig]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "c1", "c2", *columns(m)])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for _, _, words, first in _pieces(batch.column(1)):
                sets, at = K.shingles(words, first, k)
                c1, c2 = digests(sets, at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(K.signed(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(c1)), pa.array(K.signed(c2)), lists], ["c1", "c2", "items"])

    return run


def sketches(docs: DataFrame, k: int, m: int) -> DataFrame:
    """Rows (doc_id, n, c1, c2, s0.., o0..): set size, digest, signature and odd sketch of each document."""
    schema = "doc_id long, n long, c1 long, c2 long, " + ", ".join(f"{c} long" for c in columns(m))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketches(k, m), schema)


def wildcard_keys(m: int) -> Column:
    """A row's 4m numbered bucket keys: each chunk with one of its symbols left out."""
    out = []
    for c in range(m):
        for w in range(4):
            out.append(F.struct(F.lit(4 * c + w).alias("k"), F.xxhash64(F.lit(4 * c + w), F.col(f"s{c}").bitwiseAND(kept_bits(w))).alias("key")))
    return F.array(*out)


def kept_bits(w: int) -> Column:
    """Mask of a chunk's symbols without symbol w."""
    keep = (1 << 64) - 1 ^ (0xFFFF << (16 * w))
    return F.lit(keep - (1 << 64) if keep >> 63 else keep)


def first_shared(m: int) -> Column:
    """Number of the first key that the signatures a.s0.. and b.s0.. share."""
    out = None
    for c in range(m):
        x = F.col(f"a.s{c}").bitwiseXOR(F.col(f"b.s{c}"))
        for w in range(4):
            same = x.bitwiseAND(kept_bits(w)) == 0
            out = F.when(same, 4 * c + w) if out is None else out.when(same, 4 * c + w)
    return out


def reachable(percent: int) -> Column:
    """Whether the sets of a and b can reach the threshold, by their sizes and odd sketches; never false for those that do."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"a.o{i}").bitwiseXOR(F.col(f"b.o{i}"))) for i in range(ODD_WORDS)])
    fits = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return fits & ((100 + percent) * differ <= (100 - percent) * (F.col("a.n") + F.col("b.n")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full sets reach the threshold."""
    x, y = sets.select(F.col("rep").alias("u"), F.col("items").alias("x")), sets.select(F.col("rep").alias("v"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "u").join(y, "v").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("u", "v")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    m = chunks_for(percent, miss)
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.save(sketches(docs, k, m))
    known = rows.where("n > 0 and doc_id is not null")
    classes = known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), *[F.min(s).alias(s) for s in columns(m)])
    classes = scratch.save(classes)
    keyed = classes.select("rep", F.explode(wildcard_keys(m)).alias("x")).select("rep", "x.*")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Keys are written before they are joined: a join of two plain exchanges can split a hot key, one onto an aggregate can't.
    keyed = scratch.save(keyed.join(scratch.save(shared), "key").select("key", "k", "rep", "n"))
    weight = scratch.save(keyed.groupBy("rep").agg(F.sum("n").alias("w")))
    hubs = keyed.join(weight, "rep").groupBy("key").agg(F.max("w").alias("w"), F.max_by("rep", F.struct("w", -F.col("rep"))).alias("hub")).select("key", "hub")
    first = keyed.join(scratch.save(hubs), "key").where("rep <> hub").select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).distinct()
    a, b = classes.alias("a"), classes.alias("b")
    first = scratch.save(first)
    near = first.join(a, F.col("u") == F.col("a.rep")).join(b, (F.col("v") == F.col("b.rep")) & reachable(percent)).select("u", "v")
    need = classes.join(weight, "rep", "left_semi").select("c1", "c2", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(need.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")
    sets = texts.select("doc_id", "text").mapInArrow(_sets(k), "c1 long, c2 long, items array<long>")
    repeats = _repeats(rows)
    if repeats:
        sets = sets.dropDuplicates(["c1", "c2"])
    sets = scratch.save(sets.join(need, ["c1", "c2"]).select("rep", "items"))
    found = confirmed(near, sets, percent)
    if repeats:  # rows of one id are one node, also where their texts belong to different classes
        same = known.join(classes.select("c1", "c2", "rep"), ["c1", "c2"])
        found = found.unionByName(same.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct())
    found = scratch.save(found)
    comp = components(scratch, found)
    # Buckets of two have been compared already.
    placed = keyed.where("n > 2").join(comp, F.col("rep") == F.col("node"), "left").select("key", "k", "rep", F.coalesce("component_id", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    left = scratch.save(placed.join(scratch.save(mixed), "key").join(classes.select("rep", "n", *columns(m)), "rep"))
    a, b = left.alias("a"), left.alias("b")
    rest = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & reachable(percent) & (first_shared(m) == F.col("a.k")))
        .select(F.greatest("a.rep", "b.rep").alias("u"), F.least("a.rep", "b.rep").alias("v"))
        .join(first, ["u", "v"], "left_anti")
    )
    found = found.unionByName(scratch.save(confirmed(rest.distinct(), sets, percent)))
    comp = components(scratch, found)
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(named, ["c1", "c2"], "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    ids = rows.where("doc_id is not null").groupBy("doc_id").count()
    return bool(ids.where("count > 1").limit(1).count())


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; wordless documents and null ids stay."""
    found = near_duplicates(docs, k, percent)
    keep = found.where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").select(*docs.columns)
    if _repeats(found):
        known = known.dropDuplicates(["doc_id"])
    return known.unionByName(docs.where("doc_id is null"))
