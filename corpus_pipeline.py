"""Corpus preparation: filter, deduplicate, decontaminate, mix and shard ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of ``documents``; the last adds each row's shard.

Defined cases, for every stage: other columns, also such that are named like an
operator's own, pass through unchanged (the last stage renames its input's
``slot`` and ``shard`` to ``…_input``); empty tables give empty results; texts
are read whole. Nulls, empty texts, ties and repeated rows:

* toxicity: a null or empty text scores as one without matches and stays;
  repeated rows go or stay together. Without labels of both kinds a fixed list
  of eight words decides.
* near-duplicates: a null or wordless text, or a null id, is linked with
  nothing and stays; of equal rows, ids included, one stays, as of any group
  (the one of the least id).
* decontamination: null and wordless texts match nothing and stay; repeated
  rows go or stay together.
* mixing: a null source is a source; a document without words has no share and
  isn't in the mix; repeated rows are mixed as rows of their own.
* sharding: a null id is placed as the empty string; repeated rows share a
  shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, minhash, mixing, sharding, toxicity
from quern.llm.support import Scratch, passing_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learnt from ``labels`` rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles stays."""
    return minhash.deduplicate(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ``benchmark``, up to a fifth of its words edited, go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix's schedule reads the block they start in."""
    return mixing.apply(docs)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their slot and shard."""
    return sharding.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_on_shards),
]

#: The learnt lexicon and the similarity stages can't be put in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each reads what its predecessor wrote to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with passing_scratch():
            done = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)  # what the stage before wrote; input tables aren't scratch
        docs = done
    return docs
