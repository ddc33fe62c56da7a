"""Mixing sources to target weights by a low-discrepancy schedule.

1. Every document's size is its count of words. Sources in code-point order
   (null last) have weights that repeat a short list. A source's target is its
   share of all words, at most ``max_repeat`` times its own size; what a cap
   cuts off goes to the other sources by weight (closed form: with sources in
   order of size over weight, the capped ones come first).
2. Each source's documents are shuffled by a hash and laid end to end; the line
   is cut in blocks of equally many words. The schedule has one slot for each
   block of the mix, ``N_SLOTS`` at most, so its length is bounded at any size.
3. Slot j gets the point frac((j + 1/2) / golden ratio). Mapped through the
   cumulative targets it names the slot's source. The k-th slot of a source
   reads block k modulo the source's blocks: first pass, second pass, and so on.
4. Joining slots to blocks gives the words taken of each document.
5. Blocks grow with the input, so a source that has or is owed fewer than
   ``LEAST_BLOCKS`` of them gets no slots: its line is read from the start, over
   and over, until its target is met to the word.

Sums along a source never run in one task: a source is cut in hash buckets (or
chunks of slots), summed inside each, and shifted by the sums of those before.

Defined cases: a null or empty text has size 0 and is taken 0 times; null
sources form one source, ordered last; a null or repeated ``doc_id`` is a row
like any other; an empty table gives an empty result; reruns agree. Only
``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import Scratch, md5_long, prefix_offsets

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
N_SLOTS = 1 << 19
LEAST_BLOCKS = 1024
SLOTS_A_CHUNK = 4096
GRID = 1024
WORD = r"[^\x20\x09-\x0D]+"
INV_GOLDEN = 0.6180339887498949


def sized(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, key); key is a hash of id and text that tells rows of one id apart."""
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Rows (source, source_size, target, lo, hi); lo and hi bound the source's part of [0, 1]."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    all_rows = Window.partitionBy()
    poor = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = poor.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    src = src.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    src = src.withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # What a weight of 1 gets if all sources before this one are capped: it rises up to the first source that needs no cap, then falls.
    src = src.withColumn("level", F.col("left") / F.col("rest"))
    src = src.withColumn("level", F.max("level").over(all_rows))
    src = src.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
    summed = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.nullif(F.sum("target").over(all_rows), F.lit(0.0))
    return src.withColumn("hi", summed / whole).withColumn("lo", F.col("hi") - F.col("target") / whole).select("source", "rank", "source_size", "target", "lo", "hi")


def laid_out(sizes: DataFrame, n_docs: int, seed: int = 0) -> DataFrame:
    """Rows with ``start``: words of the source's shuffled line before this document."""
    buckets = max(1, isqrt(n_docs))  # as many buckets as documents a bucket
    rows = sizes.withColumn("_h", md5_long(F.lit(seed), F.col("doc_id"))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    keys = ["rank", "_b"]
    w = Window.partitionBy(*keys).orderBy("_h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    parts = prefix_offsets(rows.groupBy(*keys).agg(F.sum("size").alias("n")), "rank", "_b", "n", "offset")
    return rows.join(parts, keys).withColumn("start", F.col("start") + F.col("offset")).drop("_h", "_b", "offset")


def schedule(src: DataFrame, n_slots: int, block: int, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Rows (slot, rank, block, epoch): the source and block that each slot of the mix reads."""
    spark = src.sparkSession
    first, last = F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1))
    cells = src.where("target > 0").withColumn("cell", F.explode(F.sequence(first, last)))
    j = spark.range(n_slots).withColumnRenamed("id", "slot")
    point = (F.col("slot") + 0.5) * F.lit(INV_GOLDEN)
    j = j.withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * GRID))
    hits = j.join(cells.select("cell", "rank", "lo", "hi", "source_size"), "cell").where("u >= lo and u < hi")
    hits = hits.select("slot", "rank", F.ceil(F.col("source_size") / block).alias("blocks"), F.floor(F.col("slot") / SLOTS_A_CHUNK).alias("chunk"))
    keys = ["rank", "chunk"]
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("slot")) - 1)
    parts = prefix_offsets(hits.groupBy(*keys).agg(F.count("*").alias("n")), "rank", "chunk", "n", "offset")
    hits = hits.join(parts, keys).withColumn("k", F.col("k") + F.col("offset"))
    hits = hits.withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).where(F.col("epoch") < max_repeat)
    return hits.select("slot", "rank", (F.col("k") % F.col("blocks")).alias("block"), "epoch")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, n_slots: int = N_SLOTS, seed: int = 0) -> DataFrame:
    """Rows (doc_id, key, source, size, source_size, target, taken, copies), one for each row of ``docs``.

    ``taken`` counts the words that the slots take, repeats included. ``copies``
    is for mixes of whole documents: how often the block (or word) in which the
    document starts is read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(sized(docs))
    n_docs, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, -(-words // n_slots))
    src = scratch.save(targets(sizes, weights, max_repeat))
    named = src.withColumnRenamed("source", "_s").select("_s", "rank", "source_size", "target")
    rows = sizes.join(named, sizes["source"].eqNullSafe(F.col("_s"))).drop("_s")
    rows = scratch.save(laid_out(rows, n_docs, seed))
    # Blocks of one word can't be made smaller.
    by_word = F.lit(block > 1) & (F.least("target", "source_size") < LEAST_BLOCKS * block)
    reads = schedule(src.where(~by_word), -(-words // block), block, max_repeat).groupBy("rank", "block").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / block)
    parts = rows.where(~by_word).withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    parts = parts.select("rank", "start", "doc_id", "size", "block", inside.alias("words"), (F.col("block") == first).alias("first"))
    times = F.coalesce(F.col("times"), F.lit(0))
    # A document is its place in its source's line, so repeated and null ids stay apart; empty documents share places and get 0.
    got = (
        parts.where("size > 0")
        .join(reads, ["rank", "block"], "left")
        .groupBy("rank", "start")
        .agg(F.sum(F.col("words") * times).alias("taken"), F.max(F.when(F.col("first"), times)).alias("copies"))
    )
    full = F.col("size") > 0
    out = rows.join(got, ["rank", "start"], "left")
    zero = F.lit(0)
    owed = F.round("target").cast("long")
    line = F.greatest("source_size", F.lit(1))
    passes, rest = F.floor(owed / line), owed % line
    read = passes * F.col("size") + F.greatest(zero, F.least(F.col("size"), rest - F.col("start")))
    return out.select(
        "doc_id", "key", "source", "size", "source_size", "target",
        F.when(full & by_word, read).when(full, F.coalesce("taken", zero)).otherwise(zero).cast("long").alias("taken"),
        F.when(full & by_word, passes + (F.col("start") < rest).cast("int")).when(full, F.coalesce("copies", zero)).otherwise(zero).cast("long").alias("copies"),
    )


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` as often as its block is read, 0 to ``max_repeat`` times.

    Rows alike in id and text share their copies evenly.
    """
    copies = mix(docs, **options).groupBy("key").agg(F.round(F.avg("copies")).cast("int").alias("times")).where("times > 0")
    rows = docs.join(copies, F.xxhash64(docs["doc_id"], docs["text"]) == copies["key"])
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies["times"])).alias("__quern_copy")).drop("__quern_copy")
