"""Checks of inputs and results, each as one aggregated row or one row a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integrity(records: DataFrame, key: str, prefix: str, required: list[str]) -> DataFrame:
    """Rows, distinct ids, ids without the prefix and empty values of each required column."""
    empty = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"empty_{c}") for c in required]
    return records.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(key).alias("n_ids"),
        F.count_if(~F.col(key).cast("string").startswith(prefix)).alias("n_wrong_prefix"),
        *empty,
    )


def references(pairs: DataFrame, owner: DataFrame, pair_key: str, owner_key: str) -> DataFrame:
    """How many pairs point to ids that the owner table lacks."""
    lost = pairs.join(owner.select(F.col(owner_key).alias(pair_key)).distinct(), pair_key, "left_anti")
    return lost.agg(F.count("*").alias("n_lost"), F.countDistinct(pair_key).alias("n_lost_ids"))


def many_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """How many records have one entity, and how many several."""
    owners = pairs.groupBy(right).agg(F.countDistinct(left).alias("n"))
    return owners.agg(
        F.count("*").alias("n_records"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_shared"), F.max("n").alias("most_entities")
    )


def profile(records: DataFrame, label: str, patterns: dict[str, Column]) -> DataFrame:
    """Share of records of a label for which each condition holds."""
    return records.groupBy(label).agg(
        F.count("*").alias("n"), *[F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(name) for name, c in patterns.items()]
    )


def results(
    lists: DataFrame, key: str, ids: str, required: DataFrame, known: DataFrame, own_prefix: str, prefixes: list[str]
) -> DataFrame:
    """(rule, n_offenders) of an id-list result: repeated rows and ids, own ids, wrong prefixes, unknown ids, missing and extra rows.

    ``required`` and ``known`` hold the allowed ids in a column named ``id``.
    """
    exploded = lists.select(key, F.explode(F.split(ids, ",")).alias("id")).where("id <> ''")
    distinct = exploded.select("id").distinct()
    good = F.lit(False)
    for p in prefixes:
        good = good | F.col("id").startswith(p)
    own = F.col("id").startswith(own_prefix)
    rows = lists.select(F.col(key).alias("id")).distinct()
    rules = {
        "duplicate_rows": lists.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"),
        "repeated_ids": lists.where(F.size(F.split(ids, ",")) > F.size(F.array_distinct(F.split(ids, ",")))).select(key).distinct(),
        "self_matches": distinct.where(own),
        "wrong_prefix": distinct.where(~own & ~good),
        "unknown_ids": distinct.where(good & ~own).join(known.select("id"), "id", "left_anti"),
        "missing_rows": required.select("id").distinct().join(rows, "id", "left_anti"),
        "extra_rows": rows.join(required.select("id").distinct(), "id", "left_anti"),
    }
    report = None
    for name, offenders in rules.items():
        one = offenders.agg(F.count("*").alias("n_offenders")).select(F.lit(name).alias("rule"), "n_offenders")
        report = one if report is None else report.unionByName(one)
    return report


def outside(matches: DataFrame, candidates: DataFrame, left: str, right: str) -> DataFrame:
    """Matches that are no candidates: a warning, not an error."""
    return matches.join(candidates, [left, right], "left_anti").agg(F.count("*").alias("n_outside"))
