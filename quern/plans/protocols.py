"""Seams of the engine: what a replacement part must offer. Frames in, frames out."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class CorpusSource(Protocol):
    """Documents, paragraphs by zone, queries and citations."""

    docs: DataFrame
    paras: DataFrame
    queries: DataFrame
    edges: DataFrame


@runtime_checkable
class Index(Protocol):
    """Postings (zone, term, doc_id, tf) and tokens (doc_id, zone, pos, term)."""

    postings: DataFrame
    tokens: DataFrame
    n_docs: int


@runtime_checkable
class Ranker(Protocol):
    """(postings, query terms, number of documents) to (qid, doc_id, score)."""

    def __call__(self, post: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame: ...


@runtime_checkable
class CandidateSelector(Protocol):
    """(postings, query terms, number of documents) to (qid, doc_id)."""

    def __call__(self, post: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame: ...


@runtime_checkable
class Segmenter(Protocol):
    """A text's zone."""

    def __call__(self, text: Column) -> Column: ...


@runtime_checkable
class StatuteNormalizer(Protocol):
    """Tokens of the provisions that a text names."""

    def __call__(self, text: str) -> set[str]: ...
