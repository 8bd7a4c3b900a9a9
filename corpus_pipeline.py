"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents with test items go,
secrets are masked, and what is left is packed into sequences.

Each stage works on all that its predecessor kept. Its result is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pliego.llm import decontaminate, near, packing, queries, secrets, toxicity
from pliego.llm.common import table
from pliego.session import kept


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more; the model is fitted on labelled rows of these documents."""
    return toxicity.without_toxic(docs, queries.toxicity_model(docs, spark, sf_dir))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked at a similarity of 0.85."""
    return near.without_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item with at most 5 % of its characters edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and masks the secrets in their texts."""
    return secrets.without_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # a trained model, similarity groups and a tokenizer are not SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
