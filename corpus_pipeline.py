"""The corpus pipeline: quality, exact copies, near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir), with docs in the columns of documents,
and works on every row that the stage before kept. All but the last return rows
of docs as they are; the last returns packed pieces. Nulls, empty texts,
repeated rows and empty tables have the results that each operator's docstring
states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import bagminhash, exact_dedup, mixing, packing, quality_lm
from almanac.llm.common import read_table, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold; the verdict comes with each row."""
    return quality_lm.good_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return bagminhash.first_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' budgets take them whole."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of as many."""
    return packing.packed_digest(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: The model's perplexities and the near copies can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written and read again in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
