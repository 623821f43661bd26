"""Corpus statistics of records: document frequencies, regions, anchors and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idf_table(records: DataFrame, words: str, label: str = "cty") -> DataFrame:
    """(label, token, df, idf): ln(records of the label / records with the token)."""
    totals = records.groupBy(label).agg(F.count("*").alias("n"))
    seen = records.select(label, F.explode(F.array_distinct(words)).alias("token")).groupBy(label, "token").agg(F.count("*").alias("df"))
    return seen.join(F.broadcast(totals), label).select(label, "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def with_idf(records: DataFrame, key: str, words: str, idf: DataFrame, out: str, label: str = "cty") -> DataFrame:
    """The records with the weights of their words in the words' order; unknown words weigh 0."""
    placed = records.select(key, label, F.posexplode(words).alias("pos", "token"))
    weights = (
        placed.join(idf.select(label, "token", "idf"), [label, "token"], "left")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idf", F.lit(0.0)).alias("w")))).alias("s"))
        .select(key, F.col("s.w").alias(out))
    )
    return records.join(weights, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<double>")))


def region_vocabulary(records: DataFrame, segments: str, label: str = "cty", least_share: float = 5e-4, spaces: int = 3) -> DataFrame:
    """(label, segment): last segments of enough records of the label, of at most ``spaces`` spaces."""
    totals = records.groupBy(label).agg(F.count("*").alias("n"))
    # conditions on the last segment may be evaluated before that on the size, so it is null without segments, not an error
    last = (
        records.where(F.size(segments) > 0)
        .groupBy(label, F.try_element_at(F.col(segments), F.lit(-1)).alias("segment"))
        .agg(F.count("*").alias("k"))
    )
    few = F.length("segment") - F.length(F.replace(F.col("segment"), F.lit(" "), F.lit("")))
    return last.join(F.broadcast(totals), label).where((F.col("k") >= least_share * F.col("n")) & (few <= spaces)).select(label, "segment", "k")


def with_region(records: DataFrame, key: str, segments: str, vocabulary: DataFrame, label: str = "cty") -> DataFrame:
    """The records with ``region`` (the last segment in the vocabulary, else empty) and ``loc`` (the other segments)."""
    placed = records.select(key, label, F.posexplode(segments).alias("pos", "segment"))
    region = (
        placed.join(vocabulary.select(label, "segment"), [label, "segment"], "left_semi")
        .groupBy(key)
        .agg(F.max_by("segment", "pos").alias("region"))
    )
    return (
        records.join(region, key, "left")
        .withColumn("region", F.coalesce("region", F.lit("")))
        .withColumn("loc", F.array_sort(F.array_distinct(F.filter(segments, lambda s: s != F.col("region")))))
    )


def anchor(house: Column, street: Column) -> Column:
    """House number and first street word; empty without a house."""
    return F.when(house != "", F.concat(house, F.lit("|"), F.coalesce(F.get(street, F.lit(0)), F.lit("")))).otherwise("")


def rate(count: Column, total: Column) -> Column:
    """Scale-free frequency: ln(1 + count per 100,000)."""
    return F.log1p(count * 1e5 / F.greatest(F.lit(1), total))


def with_frequency(records: DataFrame, sides: DataFrame, value: str, out: str, label: str = "cty") -> DataFrame:
    """Counts and rates of a value among the records of another side; the empty value is not counted."""
    counts = sides.where(F.col(value) != "").groupBy(label, value).agg(F.count("*").alias(out))
    total = sides.groupBy(label).agg(F.count("*").alias("__n"))
    return (
        records.join(counts, [label, value], "left")
        .join(F.broadcast(total), label, "left")
        .withColumn(out, F.coalesce(out, F.lit(0)))
        .withColumn(f"{out}_r", rate(F.col(out), F.coalesce("__n", F.lit(0))))
        .drop("__n")
    )


def coverage(records: DataFrame, fields: list[str], label: str = "cty") -> DataFrame:
    """Share of records of a label in which each field is not empty."""
    def full(c: str) -> Column:
        kind = records.schema[c].dataType.simpleString()
        return F.size(c) > 0 if kind.startswith("array") else F.col(c) != ""

    return records.groupBy(label).agg(
        F.count("*").alias("n"), *[F.avg(F.coalesce(full(c).cast("double"), F.lit(0.0))).alias(c) for c in fields]
    )
