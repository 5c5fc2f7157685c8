"""Corpus cleaning: quality, exact, near and substring deduplication, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each as Parquet in the
shared folder and gives what it reads back to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbledger.llm.exact_dedup import first_copies
from curbledger.llm.hilbert_packing import pack
from curbledger.llm.minhash_forest import one_of_each
from curbledger.llm.substring_dedup import remaining
from curbledger.llm.weak_labels import good_documents
from curbledger.session import discard, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return one_of_each(docs, shingle=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated 20-word windows go; documents left without words go."""
    return remaining(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences along the Hilbert curve, with their ids."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packing),
]

#: A classifier is trained on the way, which SQL cannot express: tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return docs
