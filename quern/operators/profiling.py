"""Profiles of tables: counts, shapes, distributions, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct and repeated keys, and nulls of every column."""
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), (F.count(key) - F.countDistinct(key)).alias("n_repeated"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
    )


def shape(text: Column) -> Column:
    """Digits as 9, letters as a."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "a")


def top_values(df: DataFrame, value: Column, n: int = 5) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def distribution(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("most"))


def label_counts(df: DataFrame, label: str, known: list[str]) -> DataFrame:
    """(label, n, known): frequencies, and whether the mapping knows the label."""
    return df.groupBy(label).agg(F.count("*").alias("n")).select(F.col(label).alias("label"), "n", F.coalesce(F.col(label).isin(*known), F.lit(False)).alias("known"))


def overlaps(edges: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: citations, those to the pool, to the source itself, and distinct cited documents."""
    e = edges.join(pool.select(F.col("doc_id").alias("dst")).withColumn("in_pool", F.lit(1)), "dst", "left")
    return e.agg(F.count("*").alias("pairs"), F.count("in_pool").alias("to_pool"), F.count_if(F.col("src") == F.col("dst")).alias("to_self"), F.countDistinct("dst").alias("cited"))


def temporal_pairs(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: cited documents older than, as old as, younger than their source, dates known."""
    a, b = docs.select(F.col("doc_id").alias("src"), F.col("date").alias("x")), docs.select(F.col("doc_id").alias("dst"), F.col("date").alias("y"))
    e = edges.join(a, "src").join(b, "dst").where("x is not null and y is not null")
    return e.agg(F.count_if(F.col("y") < F.col("x")).alias("before"), F.count_if(F.col("y") == F.col("x")).alias("same"), F.count_if(F.col("y") > F.col("x")).alias("after"))


def prevalence(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(pattern, rows, matches)."""
    cols = [F.struct(F.lit(n).alias("pattern"), F.count_if(F.col(text).rlike(p)).alias("rows"), F.sum(F.regexp_count(text, F.lit(p))).cast("long").alias("matches")) for n, p in patterns.items()]
    return df.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def title_leaks(queries: DataFrame, titles: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, doc_id, exact, parties): whether a cited title, or both of its parties, occur in the query's text."""
    t = titles.select("doc_id", F.lower("title").alias("t"))
    rows = edges.select(F.col("src").alias("qid"), F.col("dst").alias("doc_id")).join(queries.select("qid", F.lower("text").alias("x")), "qid").join(t, "doc_id")
    parties = F.filter(F.split("t", r"\s+(?:v\.?|vs\.?|versus)\s+"), lambda p: p != "")
    return rows.select("qid", "doc_id", F.contains("x", F.col("t")).alias("exact"), ((F.size(parties) == 2) & F.forall(parties, lambda p: F.contains(F.col("x"), p))).alias("parties"))


def zone_profile(paras: DataFrame) -> DataFrame:
    """(zone, paragraphs, mean_position, late, mean_words): place of a zone's paragraphs in their documents."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    p = paras.withColumn("at", F.when(n > 1, F.col("para") / (n - 1)).otherwise(0.0))
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    return p.groupBy("zone").agg(F.count("*").alias("paragraphs"), F.avg("at").alias("mean_position"), F.avg((F.col("at") >= 0.9).cast("double")).alias("late"), F.avg(words).alias("mean_words"))


def distinctive_terms(post: DataFrame, least: int = 30, n: int = 12) -> DataFrame:
    """(zone, term, log_odds, rank): terms of a zone against all other zones, smoothed by one half."""
    c = post.groupBy("zone", "term").agg(F.sum("tf").alias("x"))
    total = Window.partitionBy("term")
    z = c.groupBy("zone").agg(F.sum("x").alias("z"))
    everything = z.agg(F.sum("z").alias("everything"))
    rows = c.withColumn("t", F.sum("x").over(total)).where(F.col("t") >= least).join(F.broadcast(z), "zone").crossJoin(F.broadcast(everything))
    inside = F.log((F.col("x") + 0.5) / (F.col("z") - F.col("x") + 0.5))
    y, rest = F.col("t") - F.col("x"), F.col("everything") - F.col("z")
    odds = inside - F.log((y + 0.5) / (rest - y + 0.5))
    rows = rows.select("zone", "term", F.round(odds, 6).alias("log_odds"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("log_odds"), "term"))).where(F.col("rank") <= n)


def zone_cosines(post: DataFrame) -> DataFrame:
    """(a, b, cosine) of the zones' document frequencies."""
    df = post.groupBy("zone", "term").agg(F.count("*").alias("df"))
    norm = df.groupBy("zone").agg(F.sqrt(F.sum(F.col("df") * F.col("df"))).alias("norm"))
    a, b = df.alias("a"), df.alias("b")
    dots = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.zone") < F.col("b.zone"))).groupBy(F.col("a.zone").alias("a"), F.col("b.zone").alias("b")).agg(F.sum(F.col("a.df") * F.col("b.df")).alias("dot"))
    na, nb = norm.select(F.col("zone").alias("a"), F.col("norm").alias("na")), norm.select(F.col("zone").alias("b"), F.col("norm").alias("nb"))
    return dots.join(F.broadcast(na), "a").join(F.broadcast(nb), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))
