"""Measures: macro F0.5, calibration, slices, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n: Column, n_true: Column) -> Column:
    """F0.5 of one entity; 1 if nothing is predicted and nothing true."""
    return F.when((n == 0) & (n_true == 0), F.lit(1.0)).otherwise(5 * tp / (5 * tp + (n_true - tp) + 4 * (n - tp)))


def entity_scores(predicted: DataFrame, truth: DataFrame, entities: DataFrame, left: str = "i1", right: str = "i23") -> DataFrame:
    """(left, tp, n_pred, n_true, f05) of every entity of the full list."""
    hits = predicted.select(left, right).distinct().join(truth.select(left, right).distinct().withColumn("__t", F.lit(1)), [left, right], "left")
    got = hits.groupBy(left).agg(F.count("*").alias("n_pred"), F.count("__t").alias("tp"))
    known = truth.groupBy(left).agg(F.countDistinct(right).alias("n_true"))
    rows = entities.select(left).distinct().join(got, left, "left").join(known, left, "left").na.fill(0, ["n_pred", "tp", "n_true"])
    return rows.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F0.5 with micro precision and recall, of all entities or by columns of the scores."""
    return scores.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg("f05").alias("macro_f05"),
        F.avg((F.col("n_pred") == 0).cast("double")).alias("share_empty"),
        F.try_divide(F.sum("tp"), F.sum("n_pred")).alias("precision"),
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("recall"),
    )


def reliability(scored: DataFrame, p: str = "p", y: str = "y", bins: int = 15) -> DataFrame:
    """(bin, n, mean_p, mean_y) by equal widths; 1 falls in the last bin."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def bootstrap(scores: DataFrame, a: str, b: str, key: str, rounds: int = 200) -> DataFrame:
    """(mean, low, high) of the mean difference a - b: 95 % interval of a Poisson bootstrap whose draws are MD5 hashes of the key."""
    # a Poisson(1) number of times, by inversion of a uniform number
    limits = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    def draw(r: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), r.cast("string")).cast("binary"))
        u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        return sum(((u >= x).cast("int") for x in limits), F.lit(0))

    diff = F.col(a) - F.col(b)
    rounds_ = scores.select(key, diff.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    means = rounds_.withColumn("w", draw(F.col("round"))).groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("m"))
    spread = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return scores.agg(F.avg(diff).alias("mean")).join(F.broadcast(spread))  # one row each


def cluster_quality(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """(purity, completeness) of pairs of records: (node, comp) against (node, entity), from sizes alone."""
    def pairs(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg((F.count("*") * (F.count("*") - 1) / 2).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"))

    both = clustered.join(truth, "node")
    one, two, three = pairs(both, "comp", "entity"), pairs(both, "comp"), pairs(both, "entity")
    rows = one.withColumnRenamed("p", "same").join(F.broadcast(two.withColumnRenamed("p", "built"))).join(F.broadcast(three.withColumnRenamed("p", "true")))
    return rows.select(F.try_divide("same", "built").alias("purity"), F.try_divide("same", "true").alias("completeness"))  # one row each


def shift(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean_before, mean_after, shift): the change of a mean in standard deviations of before."""
    def stats(rows: DataFrame, name: str) -> DataFrame:
        one = rows.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["m"].alias(f"mean_{name}"), F.col(c)["s"].alias(f"std_{name}")) for c in columns])).alias("x")).select("x.*")

    rows = stats(before, "before").join(stats(after, "after"), "feature")
    return rows.select("feature", "mean_before", "mean_after", F.try_divide(F.col("mean_after") - F.col("mean_before"), F.col("std_before")).alias("shift"))
