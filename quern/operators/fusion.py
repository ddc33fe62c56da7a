"""Rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(lists: DataFrame, k: int = K) -> DataFrame:
    """(qid, doc_id, score, rank) from ``lists(qid, list_no, doc_id, rank)``: sums of 1 / (k + rank).

    Ties go by the rank in the first list that has the document, then by document.
    """
    s = lists.groupBy("qid", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min_by("rank", "list_no").alias("first"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "first", "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).drop("first")


def completed(fused: DataFrame, base: DataFrame) -> DataFrame:
    """Fused ranks, then the remaining documents of ``base(qid, doc_id, rank)`` in their order."""
    rest = base.join(fused, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", F.lit(1).alias("part"), "rank")
    both = fused.select("qid", "doc_id", F.lit(0).alias("part"), "rank").unionByName(rest)
    return both.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("part", "rank", "doc_id")).alias("rank"))
