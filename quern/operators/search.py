"""One search request as one plan: text to ranked, explained documents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import analysis, citations
from quern.sources.corpus import Corpus

from . import evaluation, features, pruning, scoring

REQUEST = -1
RANKERS = {"tfidf": scoring.tfidf, "bm25": scoring.bm25}


def request_terms(c: Corpus, text: str, scrub: bool = False) -> DataFrame:
    """(qid, term, qtf) of a pasted text, as query ``REQUEST``, which no document is."""
    given = F.lit(text)
    given = citations.scrub(given)["text"] if scrub else given
    return c.spark.range(1).select(F.explode(analysis.terms(given)).alias("term")).groupBy(F.lit(REQUEST).cast("long").alias("qid"), "term").agg(F.count("*").alias("qtf"))


def candidates(c: Corpus, terms: DataFrame, how: str | None, k: int) -> DataFrame | None:
    """Documents that a pruning method lets through; None for all."""
    if how in (None, "none"):
        return None
    if how == "champion":
        return pruning.champion_candidates(scoring.document_weights(c.whole), terms, 50)
    if how == "elimination":
        return pruning.elimination(c.whole, terms, c.n_docs, 1.0, 2)
    if how == "tier":
        hits = terms.join(c.whole, "term").select("qid", "doc_id").distinct()
        return pruning.tier_candidates(hits, pruning.tiers(c.docs, scoring.popularity(c.edges)), k)
    if how == "cluster":
        q = scoring.query_weights(terms, scoring.frequencies(c.whole), c.n_docs)
        step = max(1, round(c.n_docs**0.5))
        return pruning.cluster_candidates(q, scoring.document_weights(c.whole), c.docs.where(F.col("doc_id") % step == 0).select("doc_id"), 2)
    raise ValueError(f"unknown pruning {how!r}")


def search(
    c: Corpus, text: str, ranker: str = "ours", prune: str | None = None, courts: list[str] | None = None, years: tuple[int, int] | None = None,
    before: datetime.date | None = None, weights: dict[str, float] | None = None, scrub: bool = False, k: int = 10, first_stage: int = 1000,
) -> DataFrame:
    """(rank, doc_id, score, parts, reasons, court, date): the k best documents for a text.

    Documents of unknown year pass the year filter, and of unknown date the date filter. "ours" is the net
    score of text, votes of the training queries nearest to the text, and authority; its rows name the
    neighbours that cite a document (``reasons``).
    """
    terms = request_terms(c, text, scrub).persist()
    scores = RANKERS["tfidf" if ranker == "ours" else ranker](c.text_index, terms, c.n_docs)
    cand = candidates(c, terms, prune, k)
    if cand is not None:
        scores = scores.join(cand, ["qid", "doc_id"], "left_semi")
    allowed = c.docs
    if courts:
        allowed = allowed.where(F.col("court").isin(*courts))
    if years:
        allowed = allowed.where(F.year("date").between(*years) | F.col("date").isNull())
    if before:
        allowed = allowed.where(features.precedes(F.col("date"), F.lit(before)))
    top = scoring.ranked(scores.join(allowed, "doc_id"), first_stage)
    if ranker == "ours":
        near = features.neighbours(c.doc_query_terms(), c.doc_queries, asked=terms)
        cited = c.edges.where("src % 5 = 0")
        rows = features.assembled(top, features.votes(near, cited), c.edges, c.doc_queries)
        names = list(features.WEIGHTS)
        w = weights or features.WEIGHTS
        rows = features.scaled(rows, names).withColumn("net", features.reweighted(w))
        out = features.ordered(rows).where(F.col("rank") <= k).withColumn("parts", features.explained(w)).withColumn("score", F.round("net", 6))
        out = out.join(features.vote_reasons(near, cited), ["qid", "doc_id"], "left").join(allowed, "doc_id")
    else:
        out = top.withColumn("parts", F.array(F.struct(F.lit("text").alias("name"), F.round("score", 5).alias("contribution"))))
        out = out.withColumn("reasons", F.lit(None).cast("array<struct<neighbour:bigint,sim:double>>"))
    return out.where(F.col("rank") <= k).select("rank", "doc_id", "score", "parts", "reasons", "court", "date").orderBy("rank")


def overlay(result: DataFrame, relevant: DataFrame) -> DataFrame:
    """P and R at 10, AP of one result list against relevant(doc_id)."""
    ranks = result.select(F.lit(0).alias("qid"), "doc_id", "rank")
    return evaluation.measures(ranks, relevant.select(F.lit(0).alias("qid"), "doc_id"), (10,)).select("p10", "r10", "ap")


def main(args: list[str] | None = None) -> None:
    """``python -m quern.operators.search FOLDER TEXT [-k K]``."""
    import argparse

    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser()
    p.add_argument("folder")
    p.add_argument("text")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--ranker", choices=["ours", *RANKERS], default="ours")
    a = p.parse_args(args)
    search(Corpus.of(SparkSession.builder.getOrCreate(), a.folder), a.text, a.ranker, k=a.k).show(a.k, truncate=False)


if __name__ == "__main__":
    main()
