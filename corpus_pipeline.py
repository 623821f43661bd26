"""The training-data pipeline: each stage works on all documents its predecessor kept.

``STAGES`` are functions of (spark, docs, sf_dir). All but the last return
the columns of ``documents``; ``run`` writes every stage's result to the
shared folder as Parquet and gives it, read again, to the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import copies, packing, quality, toxicity
from weft.llm.common import Workspace


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that are predicted to be toxic go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 at its own threshold: of documents at least 0.8 alike in five-word shingles that of the smallest id stays."""
    return copies.one_per_group(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of what is left, with their places in training sequences."""
    # workers have served the other stages, so they remember less here than alone, and look up less together
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=120_000, size=2_000_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("toxicity", clean_documents),
    ("near_duplicates", distinct_documents),
    ("packing", packed_documents),
]

#: Classifiers, tokens and components are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        rows = work.save(stage(spark, rows, sf_dir), name)
        if at:
            work.drop(STAGES[at - 1][0])
    return rows
