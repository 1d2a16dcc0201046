"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` writes each stage's result as Parquet in
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from servelens.llm import decontam, mixing, neardup, quality, sharding
from servelens.llm.common import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or a learned rule rejects go.

    A null or empty text has no words and goes; equal rows share their fate; without labels no rule is learned and
    the base test alone decides; an empty table stays empty; columns of ``labels`` never meet those of documents.
    """
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity of 0.8).

    The smallest id stays, of rows equal in it one; a text without words, null or empty, is linked with nothing
    and stays; an empty table stays empty; columns are kept as given.
    """
    return neardup.one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go.

    A null or empty text holds none and stays; items that are null or empty have no words; equal rows share their
    fate; an empty table of either kind changes nothing; columns of ``benchmark`` never meet those of documents.
    """
    return decontam.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, not at all included.

    A null source is one of its own; a null or empty text weighs nothing and is taken once; equal rows are told apart by
    number; one source is taken whole; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every row goes: one of 16 shards of near equal bytes, and its place there.

    A null or empty text has size 1; equal rows get places of their own; an empty table gives an empty plan.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned rules, hashed draws and slots have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
