"""Sinks: id-list TSV files and memoised stage tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_lists(pairs: DataFrame, entities: DataFrame, key: str, left: str, right: str, out: str) -> DataFrame:
    """One row per entity: its distinct ids in ascending order, joined by commas; empty if it has none."""
    lists = pairs.groupBy(F.col(left).alias(key)).agg(F.array_join(F.array_sort(F.collect_set(right)), ",").alias(out))
    return entities.select(key).join(lists, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def write_tsv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Tab-separated files in a global order, never quoted; file names ascend with the order."""
    rows.orderBy(*order).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option(
        "escapeQuotes", False
    ).option("emptyValue", "").csv(path)


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path`` if its write completed, else the result of ``make`` written there."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def without(pairs: DataFrame, emptied: DataFrame, key: str) -> DataFrame:
    """A probe result: the lists of the entities in ``emptied`` go."""
    return pairs.join(emptied.select(key), key, "left_anti")


def append_ledger(spark: SparkSession, path: str, entries: dict[str, float], step: str) -> DataFrame:
    """Add (step, measure, value) rows to the ledger at ``path``; returns all of it. A step that is written again replaces its rows when read."""
    rows = spark.createDataFrame([(step, k, float(v)) for k, v in entries.items()], "step string, measure string, value double")
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    every = spark.read.schema("step string, measure string, value double, at timestamp").parquet(path)
    return every.groupBy("step", "measure").agg(F.max_by("value", "at").alias("value"))
