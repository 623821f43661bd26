"""An extension for records that arrive later: a stream joined with fixed postings, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(arriving: DataFrame, posted: DataFrame, query: str, entity: str, label: str = "cty") -> DataFrame:
    """(label, query, entity, score): shared keys of arriving records with fixed postings, summed by record.

    ``arriving``: (label, query, keys); the static side is re-read by every micro-batch.
    """
    keyed = arriving.select(label, query, F.explode(F.array_distinct("keys")).alias("key"))
    return keyed.join(posted.select(label, entity, "key", "idf"), [label, "key"]).groupBy(label, query, entity).agg(F.sum("idf").alias("score"))


def link_batches(arriving: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a decision on each micro-batch and write its links once: a batch that is repeated replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts of events by tumbling window, dropping what is later than ``late`` (batch tables drop nothing)."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *by)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), *by, "n", "total")
    )
