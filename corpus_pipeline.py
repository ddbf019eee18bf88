"""The corpus pipeline: documents to a training mix in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read as
the next one's ``docs``; all but the last return the columns of ``documents``. Each works on every row
that the one before kept:

1. toxicity: documents that the model predicts toxic go; it learns from ``labels``, without the held-out rows.
2. near_dedup: one document of each near-duplicate group stays (five-word shingles, Jaccard 0.8).
3. decontamination: documents that contain 80 % of a benchmark item's shingles go.
4. secret_scan: owner-specific values are masked in the text, widely copied ones stay; every document stays.
5. mixing: documents get copies so that sources meet their targets; documents without a copy go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagecast.llm.common import stash, table
from stagecast.llm.decontaminate import decontaminated
from stagecast.llm.mixing import mixed_documents
from stagecast.llm.near_duplicates import deduplicated
from stagecast.llm.secret_scan import redacted
from stagecast.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("mixing", mixing)]

#: The trained model of the first stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
