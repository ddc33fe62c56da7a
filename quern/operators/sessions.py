"""Per-user limits: sliding windows, bounded history, idempotent saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, user: str, ts: str, seconds: int = 60, limit: int = 12) -> DataFrame:
    """Events with the number in the user's window that ends at each, and whether that is within the limit."""
    w = Window.partitionBy(user).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= limit)


def newest(events: DataFrame, user: str, key: str, n: int = 200) -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.desc(key))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_saves(items: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The first id of each distinct item."""
    return items.groupBy(*keys).agg(F.min(key).alias(key))
