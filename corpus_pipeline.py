"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and is written as Parquet before the next begins.

Defined results: null and blank texts go in the first stage (no label and no word
says that they are clean); of equal and of similar texts the row with the smallest
identifier stays, nulls last; rows with a null identifier, repeated rows, ties and
very long texts go through all stages as the stages define; other columns are
carried to the last stage, whatever their names; an empty table gives an empty
result of the same schema.

The stages that send texts to Python bound their batches by bytes, so that what an
executor holds doesn't depend on how long the texts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import exact, jaccard, mixing, packing, puquality
from shardloom.llm.common import bounded_batches, table
from shardloom.shared import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return puquality.quality_stage(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return jaccard.near_stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_stage(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mixture), ("packing", packed)]

#: Model fitting, set similarity with its components and online packing are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    folder = shared_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs
