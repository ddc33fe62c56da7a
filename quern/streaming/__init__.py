"""Structured Streaming counterparts of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import analysis


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "60 seconds", slide: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Events a key and sliding window; what comes later than the watermark is dropped."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def new_content(docs: DataFrame, ts: str = "ts", k: int = 4) -> DataFrame:
    """The first document of each set of shingles. State is one flag a digest, kept by the digest's task."""
    digest = F.xxhash64(F.array_sort(analysis.shingles(F.col("text"), k)))
    keyed = docs.select("doc_id", digest.alias("digest"))

    def first(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.exists
        for part in parts:
            if not seen and len(part):
                seen = True
                state.update((True,))
                yield pd.DataFrame({"doc_id": [part["doc_id"].min()], "digest": [key[0]]})

    return keyed.groupBy("digest").applyInPandasWithState(first, "doc_id long, digest long", "seen boolean", "append", "NoTimeout")
