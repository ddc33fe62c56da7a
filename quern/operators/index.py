"""Zoned, positional inverted index as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import analysis, codec
from quern.sources.corpus import POSITIONAL, write_table

#: Derived zones: facts and issues together, and the whole text.
TARGETS = {"fi": ("facts", "issues")}


def tokens(paras: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, zone, pos, term): positions run over all paragraphs of a zone, stop words gone.

    Positions come from sums within a (document, zone), so no window is wider than a document.
    """
    lines = paras.select("doc_id", "zone", "para", analysis.terms(F.col("line")).alias("ts")).where(F.size("ts") > 0)
    w = Window.partitionBy("doc_id", "zone").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum(F.size("ts")).over(w), F.lit(0)))
    out = lines.select("doc_id", "zone", "before", F.posexplode("ts").alias("i", "term")).select("doc_id", "zone", (F.col("before") + F.col("i")).cast("int").alias("pos"), "term")
    return analysis.with_stems(out) if stem else out


def postings(toks: DataFrame) -> DataFrame:
    """(zone, term, doc_id, tf) of the zones, of ``fi`` and of ``all``.

    Each zone's frequencies are counted first; the derived zones add them up.
    """
    own = toks.groupBy("zone", "term", "doc_id").agg(F.count("*").alias("tf"))
    wider = F.array(F.lit("all"), F.when(F.col("zone").isin(*TARGETS["fi"]), F.lit("fi")))
    more = own.select(F.explode(F.array_compact(wider)).alias("zone"), "term", "doc_id", "tf")
    return own.unionByName(more.groupBy("zone", "term", "doc_id").agg(F.sum("tf").alias("tf")))


def whole_text_postings(paras: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of whole texts, without zones."""
    terms = paras.select("doc_id", F.explode(analysis.terms(F.col("line"))).alias("term"))
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def positions(toks: DataFrame) -> DataFrame:
    """(zone, term, doc_id, positions) of the zones that keep them."""
    kept = toks.where(F.col("zone").isin(*POSITIONAL))
    return kept.groupBy("zone", "term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def dictionary(post: DataFrame) -> DataFrame:
    return post.groupBy("zone", "term").agg(F.count("*").alias("df"))


def lengths(post: DataFrame, docs: DataFrame) -> DataFrame:
    """(zone, doc_id, len), with 0 for documents without the zone."""
    zones = post.select("zone").distinct()
    known = post.groupBy("zone", "doc_id").agg(F.sum("tf").alias("len"))
    every = docs.select("doc_id").crossJoin(F.broadcast(zones))  # ten zones at most
    return every.join(known, ["zone", "doc_id"], "left").select("zone", "doc_id", F.coalesce("len", F.lit(0)).cast("long").alias("len"))


def sizes(post: DataFrame) -> DataFrame:
    """Per zone: terms, postings, tokens, bytes as 4-byte integers and with gaps in variable bytes (document numbers restart a term)."""
    w = Window.partitionBy("zone", "term").orderBy("doc_id")
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(w), F.lit(0))
    p = post.withColumn("gap", gap)
    per_term = p.groupBy("zone", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("tokens"), F.sum(codec.vbyte_size(F.col("gap")) + codec.vbyte_size(F.col("tf"))).alias("bytes")
    )
    return per_term.groupBy("zone").agg(
        F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("tokens").cast("long").alias("tokens"),
        F.sum(8 * F.col("df") + 4).cast("long").alias("raw_bytes"), F.sum(F.col("bytes") + codec.vbyte_size(F.col("df"))).cast("long").alias("vbyte_bytes"),
    )


def preview(post: DataFrame, n_docs: int, term: str, most: int = 500) -> DataFrame:
    """Postings of a term by zone, with df and idf."""
    w = Window.partitionBy("zone")
    rows = post.where(F.col("term") == term).withColumn("df", F.count("*").over(w))
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("doc_id"))).where(F.col("i") <= most)
    return rows.select("zone", "doc_id", "tf", "df", F.log10(n_docs / F.col("df")).alias("idf"))


def write(path: str, toks: DataFrame, docs: DataFrame) -> None:
    """Postings by zone, sorted in each file by (term, doc_id); documents; positions."""
    post = postings(toks)
    write_table(post.repartition("zone", "term").sortWithinPartitions("zone", "term", "doc_id"), f"{path}/postings", "zone")
    write_table(positions(toks), f"{path}/positions", "zone")
    write_table(docs, f"{path}/docs")


def read(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "positions", "docs")}


def intersection_costs(pairs: DataFrame) -> DataFrame:
    """(…, a, b: sorted lists) with the common documents and comparisons of a plain and a skipping merge."""
    @F.pandas_udf("struct<common:int,plain:int,skip:int>")
    def cost(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            x, y = list(x), list(y)
            common, plain = codec.skip_cost(x, y, False)
            rows.append((common, plain, codec.skip_cost(x, y, True)[1]))
        return pd.DataFrame(rows, columns=["common", "plain", "skip"])

    return pairs.withColumn("c", cost("a", "b")).select(*[c for c in pairs.columns if c not in ("a", "b")], "c.common", "c.plain", "c.skip")


def position_sizes(toks: DataFrame) -> DataFrame:
    """(zone, lists, positions, bytes, checksum): position lists as gaps in variable bytes, and the sum of (position + 1) after decoding them."""
    packed = positions(toks).select("zone", codec.pack("positions").alias("blob"), F.size("positions").alias("n"))
    rows = packed.select("zone", "n", F.octet_length("blob").alias("bytes"), codec.unpack("blob").alias("positions"))
    rows = rows.withColumn("sum", F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p + 1))
    return rows.groupBy("zone").agg(F.count("*").alias("lists"), F.sum("n").cast("long").alias("positions"), F.sum("bytes").cast("long").alias("bytes"), F.sum("sum").alias("checksum"))
