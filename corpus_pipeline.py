"""The corpus pipeline: language ID, exact dedup, near-duplicate join, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but
the last return the columns of ``documents``; the last returns the pieces with their places in
the packed sequences. Stages are written as Parquet and read again, so each starts from a
table and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxloom.llm import best_fit, content_sort, language, ngram_join
from fluxloom.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the models learn from the labelled rows of ``docs``.

    Rejected are texts that are null or hold no letter, and those that no learned language explains.
    If no row has a label there is nothing to compare with, and all rows stay.
    """
    models = language.fit(docs)
    return language.keep_identified(docs, models) if models else docs


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, blanks aside."""
    return content_sort.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by n-gram Jaccard similarity."""
    return ngram_join.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return best_fit.pack_documents(docs, capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

ORACLE_SQL = None  # language models and n-gram similarity are beyond SQL; tests/llm holds the run against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
