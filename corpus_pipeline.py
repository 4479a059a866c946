"""Training corpus from documents: quality classifier, exact dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns documents; the last one returns packed pieces. The result of a stage is
written as Parquet to the shared folder and read again as the next one's documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atrium.llm import common, dedup, jaccard, mixing, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on weak labels rejects go."""
    return quality.good_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return dedup.distinct_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays."""
    return jaccard.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, in training order; a document may come twice, the last of a source may be cut."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.packed(common.saved(packing.token_pieces(docs), "pieces"))


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_dedup), ("n-gram Jaccard join", jaccard_join),
          ("mixing", mix_sources), ("best-fit packing", pack_sequences)]
# The classifier's fit and the packing cannot be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
