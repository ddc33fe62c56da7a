"""Tolerant lookup: wildcards, k-gram similarity, spelling, phonetic codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.analysis import char_grams

MOST = 500


def wildcard_like(pattern: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", pattern.lower()).replace("*", "%")


def wildcard(terms: DataFrame, pattern: str, most: int = MOST) -> DataFrame:
    """Terms that match a pattern with ``*``; a fixed beginning is pushed to the scan."""
    return terms.where(F.col("term").like(wildcard_like(pattern))).orderBy("term").limit(most)


def gram_index(terms: DataFrame, k: int = 3) -> DataFrame:
    return terms.select("term", F.explode(char_grams(F.col("term"), k)).alias("gram"))


def similar(terms: DataFrame, words: DataFrame, least: float = 0.2, k: int = 3) -> DataFrame:
    """(word, term, jaccard) for ``words(word)``, by shared k-grams."""
    index = terms.select("term", char_grams(F.col("term"), k).alias("g")).select("term", F.size("g").alias("nt"), F.explode("g").alias("gram"))
    asked = words.select("word", char_grams(F.col("word"), k).alias("g")).select("word", F.size("g").alias("nw"), F.explode("g").alias("gram"))
    both = asked.join(index, "gram").groupBy("word", "term", "nw", "nt").agg(F.count("*").alias("n"))
    j = F.col("n") / (F.col("nw") + F.col("nt") - F.col("n"))
    return both.select("word", "term", j.alias("jaccard")).where(F.col("jaccard") >= least)


def suggestions(dictionary: DataFrame, words: DataFrame, n: int = 5, most_edits: int = 2) -> DataFrame:
    """(word, term, distance, df, rank) for words of three letters or more that the dictionary(term, df) lacks."""
    from pyspark.sql import Window

    asked = words.where(F.length("word") >= 3).join(dictionary, F.col("word") == F.col("term"), "left_anti")
    near = similar(dictionary.select("term"), asked).join(dictionary, "term")
    near = near.withColumn("distance", F.levenshtein("word", "term", most_edits)).where("distance >= 0")
    w = Window.partitionBy("word").orderBy("distance", F.desc("df"), "term")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("word", "term", "distance", "df", "rank")


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or ``most`` + 1 beyond it."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def soundex_groups(terms: DataFrame) -> DataFrame:
    """(code, term) of alphabetic words longer than two letters."""
    return terms.where(F.col("term").rlike("^[A-Za-z]{3,}$")).select(F.soundex("term").alias("code"), F.lower("term").alias("term")).distinct()


def sounds_like(terms: DataFrame, word: str) -> DataFrame:
    return soundex_groups(terms).where(F.col("code") == F.soundex(F.lit(word))).select("term")


def suggest(terms: DataFrame, dictionary: DataFrame, word: str) -> DataFrame:
    """(kind, term) for one word: wildcard expansions, or spellings and like sounds."""
    if "*" in word:
        return wildcard(terms, word).select(F.lit("wildcard").alias("kind"), "term")
    asked = terms.sparkSession.range(1).select(F.lit(word.lower()).alias("word"))
    spelt = suggestions(dictionary, asked).select(F.lit("spelling").alias("kind"), "term")
    return spelt.unionByName(sounds_like(terms, word).select(F.lit("soundex").alias("kind"), "term"))
