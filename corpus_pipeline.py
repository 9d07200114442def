"""A training corpus from documents: reject poor texts, drop exact and near copies, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martlight.llm import near_copies
from martlight.llm.common import table, written
from martlight.llm.exact_dedup import keep_distinct
from martlight.llm.packing import pack
from martlight.llm.quality import keep_good
from martlight.llm.simhash import keep_one
from martlight.session import tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return keep_good(docs, table(tune(spark), sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group by the contract of op8_simhash (4 bits); ``similar`` also checks its pairs and finds those further apart."""
    return keep_one(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies: candidates by fingerprints, as in ``near``, and by hash minima, of
    which those that share at least 0.8 of their five-word shingles are linked."""
    return near_copies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2,048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", similar), ("packing", packed)]

#: Fitting a model, fingerprints and packing cannot be said in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
