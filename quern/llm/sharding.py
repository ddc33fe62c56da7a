"""Sharding by a permutation-filled lookup table (consistent placement).

Every shard has its own order of preference over the slots of a prime-sized
table. Shards take turns; on its turn a shard claims the first slot of its
order that is still free. When all slots are claimed, a document's slot is its
hash modulo the table size, and the table names its shard. Shard sizes differ
by at most one slot, and dropping a shard moves few other slots.

The table has ``table_size`` rows whatever the corpus, so its broadcast is
bounded; placing a row is one probe and no shuffle.

Defined cases: a null ``doc_id`` is placed as the empty string; repeated rows
land in the same shard; an empty table gives an empty result; an input column
named like an output column is kept under its name with ``_input`` after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import md5_long

N_SHARDS, TABLE_SIZE = 64, 16381


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of its shard. ``table_size`` must be prime, so that each order visits all slots."""
    if not is_prime(table_size):
        raise ValueError("table_size must be prime")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    if len(shards) > table_size:
        raise ValueError("more shards than slots")
    at = [_digits(f"{s}/offset") % table_size for s in shards]
    step = [_digits(f"{s}/skip") % (table_size - 1) + 1 for s in shards]
    owner, free = [-1] * table_size, table_size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % table_size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def table_frame(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """The lookup table as rows (slot, shard), made in the JVM from one literal."""
    text = F.lit(",".join(map(str, owner)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(text, ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, table_size: int) -> Column:
    return F.pmod(md5_long(key), F.lit(table_size)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """All rows of ``docs`` with columns ``slot`` and ``shard`` (index into ``shards``)."""
    owner = lookup_table(shards or shard_names(N_SHARDS), table_size)
    table = F.broadcast(table_frame(docs.sparkSession, owner))
    for name in ("slot", "shard"):
        free = name
        while free in docs.columns and name in docs.columns:
            free += "_input"
        docs = docs.withColumnRenamed(name, free)
        key = free if key == name else key
    rows = docs.withColumn("slot", slot_of(F.col(key), table_size))
    return rows.join(table, "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")
