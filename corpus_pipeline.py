"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage works on all its predecessor kept.  All but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences.  Nulls, empty texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import exact_dedup, near_dedup, packing, pii, quality
from panelloom.llm.queries import vocabulary
from panelloom.llm.storage import Workspace, scratch

#: Per cent of shared word shingles from which the stage takes documents for near duplicates (the query op7 takes 85).
NEAR = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id.  Near is a similarity of ``NEAR`` per cent or more.

    The bands miss a pair of similarity exactly 0.80 with probability (1 - 0.8 ** 5) ** 25, about 5e-5; more alike, less.
    """
    return near_dedup.drop_near_copies(docs, threshold=NEAR)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("pii", private), ("packing", packed)]

#: A classifier's weights and message passing can't be written in SQL: brute-force versions stand in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.  Only their table stays in the shared folder."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch():  # what a stage wrote on its way goes when its rows are written
            docs = work.settle(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
