"""The corpus pipeline: quality rules, language identification, near-duplicate removal, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import jaccard, langid, packing, pii, quality
from strataloom.llm.queries import BYTES, PIECES, vocabulary
from strataloom.llm.store import materialize
from strataloom.runtime import importable, table

LEAST_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base counts or lie outside their script's fertility bands."""
    importable(spark)
    return quality.keep_documents(docs, vocabulary(PIECES), vocabulary(BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language or with a calibrated score below ``LEAST_LANGUAGE_SCORE``."""
    importable(spark)
    return langid.keep_documents(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    importable(spark)
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    importable(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; one row per piece."""
    importable(spark)
    return packing.pack(docs, vocabulary(BYTES)).drop("ids")


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack_sequences", pack_sequences)]

# Vocabulary measures, trained models and greedy packing have no SQL form; tests/llm/test_tables.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
