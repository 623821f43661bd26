"""Training rows for the classifiers: a bounded, deterministic sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Workspace, fold_of


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, most: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, float]:
    """((id, text, y) of at most ``most`` labelled ids a class, share of label 1 among all labelled ids).

    Fold 0 never takes part. An id that is labelled twice counts once, as 1 if
    any of its labels is 1; of the documents of a repeated id the text with the
    smallest hash is taken. The ids of a class are those with the smallest
    hash, and the rows are written once, so every use sees the same sample at
    every partitioning. Only ids are ordered; texts are fetched by a join with
    the bounded sample.
    """
    own = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold_of(F.col("id"), folds) != 0))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    share = own.agg(F.avg("y")).first()[0]
    parts = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = (
        texts.join(F.broadcast(sample), "id")  # at most 2 * most rows
        .groupBy("id", "y")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
        .select("id", "t.text", "y")
    )
    return Workspace(docs.sparkSession, "labelled").save(found, "sample"), 0.5 if share is None else float(share)
