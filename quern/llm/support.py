"""Shared plumbing: scratch tables in the cluster's shared folder, row digests, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set only where the session names no checkpoint folder, as in local tests.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[key] = "file://" + folder
    return _LOCAL[key]


#: Rows that a Python worker gets at a time, at most.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_ROOTS: list[tuple[SparkSession, str]] = []


@contextmanager
def passing_scratch():
    """Scratch folders made inside go at the end: for callers that have written their result elsewhere by then."""
    before = len(_ROOTS)
    try:
        yield
    finally:
        for spark, root in _ROOTS[before:]:
            Scratch.delete(spark, root)
        del _ROOTS[before:]


class Scratch:
    """Written tables that cut lineage: a lost executor costs a read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        small_batches(spark)
        self.spark = spark
        self.root = root
        if not root:
            self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    @staticmethod
    def path_of(df: DataFrame) -> str:
        """Where a table made by :meth:`save` is."""
        return df._quern_path

    def release(self) -> None:
        """Let Spark's cleaner drop shuffle files of finished steps, which it does as the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by :meth:`save` that no later step reads."""
        path = getattr(df, "_quern_path", None)
        if path:
            self.drop_path(path)

    def drop_path(self, path: str) -> None:
        self.delete(self.spark, path)

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def md5_long(*cols: Column) -> Column:
    """60-bit non-negative integer from the MD5 of the columns as text; null counts as ''."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def prefix_offsets(parts: DataFrame, group: str, part: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier parts of a group; one row a part, so groups stay short."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")).drop(value)


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links(u, v)`` as rows (node, component_id).

    Alternating large-star and small-star steps: each points nodes at the least
    neighbour they know, so that star-shaped links settle in two rounds. The
    least node of a component names it and is a row too. Nodes without links are
    not returned.
    """
    e = scratch.save(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are written: a hub's rows then are in a plain exchange, which can be split.
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        scratch.drop(least)
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        nxt = scratch.save(small)
        seen = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        for old in (large, least, e):
            scratch.drop(old)
        e = nxt
        if (seen["n"], seen["h"]) == mark:
            heads = e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(heads)
        mark = (seen["n"], seen["h"])


#: Bits of a key filter; its broadcast is 128 KB whatever the number of keys.
FILTER_BITS = 1 << 20


def key_filter(keys: DataFrame, key: str) -> Column:
    """A predicate that all rows with a key of ``keys`` pass, and few others while keys are fewer than bits.

    A one-hash Bloom filter of fixed size. With more keys it passes more rows,
    and in the end all: it saves shuffling, and a join must follow.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(bit, 6).alias("w"), F.expr("1L").alias("one"), F.pmod(bit, F.lit(64)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("b"))).alias("v")).collect()
    have = {r["w"]: r["v"] for r in words}  # FILTER_BITS / 64 rows at most
    text = ",".join(str(have.get(i, 0)) for i in range(FILTER_BITS // 64))
    table = F.split(F.lit(text), ",").cast("array<bigint>")
    word = F.get(table, F.shiftright(bit, 6).cast("int"))
    return F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1


SALTS = 64


def salted_join(rows: DataFrame, few: DataFrame, on: str, spread: Column, how: str = "left") -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key. A key may hold a third of ``rows``:
    they are dealt out by a salt made of ``spread``, and ``few`` is repeated for each salt."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(few, [on, "_salt"], how).drop("_salt")
