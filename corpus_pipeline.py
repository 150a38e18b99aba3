"""The corpus pipeline: five stages over ``documents``, each written before the next.

Every stage but the last keeps the columns of ``documents``; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import write_table
from tidemark.llm.decontamination import clean_documents
from tidemark.llm.line_dedup import deduplicated_documents
from tidemark.llm.mixing import mix, quality_weights
from tidemark.llm.quality import good_documents
from tidemark.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the Kneser-Ney classifier rejects."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten or more documents; documents left empty stay."""
    return deduplicated_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, quality_weights(labels)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("mixing to target weights", mixture)]

#: Smoothed perplexities, filters and latent spaces have no SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = write_table(docs, "stage")
    return docs
