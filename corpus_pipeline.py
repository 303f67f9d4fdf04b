"""Cleaning and packing a document table: quality rules, exact and near deduplication, secret redaction, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import delete, documents, scratch, shared_folder
from lodestone.llm.exact_dedup import drop_exact
from lodestone.llm.packing import packed
from lodestone.llm.quality import quality_filter
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.secrets import redact
from lodestone.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar fingerprints, the document with the smallest id."""
    return drop_near(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, owner-specific credentials masked."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packed(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]
#: SQL can express neither fingerprints by XXH64 nor tokenization; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's rows are written as Parquet in the shared folder and read again.

    Once a stage is written, its working tables and the rows that it read are deleted.
    """
    docs, before = documents(spark, sf_dir), None
    folder = f"{shared_folder(spark)}/lodestone/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
