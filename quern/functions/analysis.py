"""Text analysis as column expressions: tokens, stop words, stems, n-grams.

Everything is JVM-side but the stemmer, which runs over the distinct terms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import porter

#: Words that are not indexed.
ENGLISH_STOP = tuple(
    """
a about above after again against all am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further
had has have having he her here hers herself him himself his how i if in into is it its itself
me more most my myself no nor not of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom
why will with would you your yours yourself yourselves also may shall upon thus hence
""".split()
)
LEGAL_STOP = tuple(
    """
aforesaid hereinafter herein hereto hereby thereof thereto thereby therein whereas whereof
hon'ble honble hon ble ld sd learned said versus vs
""".split()
)
MIN_LENGTH, MAX_LENGTH = 2, 40

#: What is a placeholder, a word, the number of a provision, and the words that mark one.
PLACEHOLDER = r"\[[A-Z][A-Z_ ]{2,20}\]"
WORD = r"[a-z0-9]+(?:['’][a-z]+)?"
NUMBER = r"\d+[a-z]{0,2}(?:\(\w{1,3}\))*"
MARKS = {"s": ("section", "sections", "sec", "secs", "u/s", "u/ss"), "art": ("article", "articles", "art", "arts")}
#: Stands between the code and the number of a reference while a text is cut in words.
HINGE = "\x01"


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, " ")


def with_references(low: Column) -> Column:
    """References to sections and articles of a lower-cased text as one word each: code, hinge, number."""
    for code, names in MARKS.items():
        low = F.regexp_replace(low, rf"(?U)\b(?:{'|'.join(names)})\b\s*\.?\s*({NUMBER})", f" {code}{HINGE}$1 ")
    # A bare "s" needs its dot, and isn't the end of a possessive.
    return F.regexp_replace(low, rf"(?U)(?<![\w'’])s\.\s*({NUMBER})", f" s{HINGE}$1 ")


def tokens(text: Column) -> Column:
    """Lower-case tokens; references to sections and articles come as ``s.<number>`` and ``art.<number>``.

    Texts without a digit have no references, and most have no apostrophe: they take the shorter ways.
    """
    low = F.lower(text)

    def bare(t: Column) -> Column:
        return F.regexp_replace(t, "['’]s$", "")

    words = F.regexp_extract_all(low, F.lit(WORD), 0)
    apostrophe = F.contains(low, F.lit("'")) | F.contains(low, F.lit("’"))
    full = F.regexp_extract_all(with_references(low), F.lit(rf"(?U)[a-z]+{HINGE}{NUMBER}|{WORD}"), 0)
    full = F.transform(full, lambda t: F.when(F.contains(t, F.lit(HINGE)), F.replace(t, F.lit(HINGE), F.lit("."))).otherwise(bare(t)))
    return F.when(low.rlike(r"(?U)\d"), full).when(apostrophe, F.transform(words, bare)).otherwise(words)


def is_reference(token: Column) -> Column:
    return token.rlike(r"^(s|art)\..*\d")


def kept(token: Column) -> Column:
    n = F.length(token)
    return (n >= MIN_LENGTH) & (n <= MAX_LENGTH) & ~token.isin(*sorted(set(ENGLISH_STOP) | set(LEGAL_STOP)))


def terms(text: Column) -> Column:
    """Index terms without stemming: placeholders and stop words are gone."""
    return F.filter(tokens(strip_placeholders(text)), kept)


@F.pandas_udf(T.StringType())
def porter_stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: porter.stem(w) if w and len(w) > 3 and w.isalpha() else w)


def with_stems(rows: DataFrame, column: str = "term") -> DataFrame:
    """``rows`` with ``column`` stemmed; the stemmer runs once a distinct term."""
    known = rows.select(column).distinct().withColumn("_stem", F.when(is_reference(F.col(column)), F.col(column)).otherwise(porter_stems(F.col(column))))
    return rows.join(known, column).withColumn(column, F.col("_stem")).drop("_stem")


def simple_tokens(text: Column) -> Column:
    """Tokens of the small demonstration corpus."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def char_grams(word: Column, k: int = 3) -> Column:
    """Distinct k-grams of ``$word$``."""
    padded = F.concat(F.lit("$"), word, F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - (k - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(padded, i, F.lit(k))))


def shingles(text: Column, k: int = 4) -> Column:
    """Distinct k-word windows of the lower-cased words, joined by blanks; a shorter text is one shingle."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def windows(ws: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1)))
        many = F.transform(at, lambda i: F.array_join(F.slice(ws, i, k), " "))
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    # An array of one element binds the words, which would else be split again for every window.
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(words), windows), 1))


def shingle_hashes(text: Column, k: int = 4) -> Column:
    return F.array_distinct(F.transform(shingles(text, k), lambda s: F.crc32(s.cast("binary"))))


def clip(text: Column, size: int = 200) -> Column:
    """Blanks collapsed; at most ``size`` characters and a mark of what is left out."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def issue_statements(text: Column, least: int = 8) -> Column:
    """Statements of a text: cut at sentence ends, before "Whether" and before numbered items; short ones join the next."""
    cut = r"(?<=[.?;:])\s+(?=[A-Z(\[\d])|\s+(?=Whether\b)|\s+(?=\(\s*(?:[ivx]+|[a-z]|\d+)\s*\)\s)"
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), cut), lambda p: F.trim(p)), lambda p: p != "")
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        now = F.trim(F.concat_ws(" ", acc["open"], part))
        short = words(now) < least
        return F.struct(
            F.when(short, acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"),
            F.when(short, now).otherwise(F.lit("")).alias("open"),
        )

    def close(acc: Column) -> Column:
        done, rest = acc["done"], acc["open"]
        last = F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), rest)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(last))
        return F.when(rest == "", done).when(F.size(done) == 0, F.array(rest)).otherwise(joined)

    return F.aggregate(parts, start, add, close)
