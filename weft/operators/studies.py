"""Studies of a corpus and its truth: assumptions behind the linkage, samples, leave-one-out reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.models import share


def unmatched_share(records: DataFrame, truth: DataFrame, source: str, key: str = "i23") -> DataFrame:
    """(source, n, unmatched): share of a source's records that no entity owns (distractors)."""
    owned = truth.select(key).distinct().withColumn("__t", F.lit(1))
    return records.join(owned, key, "left").groupBy(source).agg(
        F.count("*").alias("n"), F.avg(F.col("__t").isNull().cast("double")).alias("unmatched")
    )


def repeats(truth: DataFrame, records: DataFrame, source: str, left: str = "i1", right: str = "i23") -> DataFrame:
    """(source, mean_per, share_several, most): records of one source that an entity owns, where it owns any."""
    per = truth.join(records.select(right, source), right).groupBy(left, source).agg(F.count("*").alias("n"))
    return per.groupBy(source).agg(
        F.avg("n").alias("mean_per"), F.avg((F.col("n") >= 2).cast("double")).alias("share_several"), F.max("n").alias("most")
    )


def label_agreement(truth: DataFrame, left_labels: DataFrame, right_labels: DataFrame, label: str = "cty", left: str = "i1", right: str = "i23") -> DataFrame:
    """(n, agreement): matched pairs whose records have the same label; null labels agree with nothing."""
    rows = truth.join(left_labels.select(left, F.col(label).alias("a")), left).join(right_labels.select(right, F.col(label).alias("b")), right)
    return rows.agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("a") == F.col("b")).cast("double"), F.lit(0.0))).alias("agreement"))


def leakage(pairs: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(check, correlation): Pearson's, of each named pair of columns over matched pairs; near 0 if ids carry no signal."""
    found = pairs.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(name) for name, (a, b) in columns.items()])
    named = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("correlation")) for c in columns])
    return found.select(F.explode(named).alias("x")).select("x.*")


def density(records: DataFrame, label: str, source: str, sources: list[str], own: str) -> DataFrame:
    """Counts of each source by label, and how many records of the other sources there are for one of ``own``."""
    counts = records.groupBy(label).pivot(source, sources).agg(F.count(F.lit(1))).na.fill(0)
    others = sum((F.col(f"`{s}`") for s in sources if s != own), F.lit(0))
    return counts.withColumn("per_own", F.try_divide(others, F.col(f"`{own}`")))


def repeated_share(records: DataFrame, label: str, values: dict[str, Column]) -> DataFrame:
    """Share of a label's records whose value another record has too (chains, malls); by counts, so hot values do not gather."""
    total = records.groupBy(label).agg(F.count("*").alias("n"))
    for name, value in values.items():
        counts = records.groupBy(F.col(label), value.alias("__v")).agg(F.count("*").alias("k"))
        # a value may repeat across labels
        every = counts.groupBy("__v").agg(F.sum("k").alias("all"))
        marked = counts.join(every, counts["__v"].eqNullSafe(every["__v"]))
        one = marked.groupBy(label).agg(F.sum(F.when(F.col("all") > 1, F.col("k")).otherwise(0)).alias("__k"))
        total = total.join(one, label, "left").withColumn(f"share_{name}", F.col("__k") / F.col("n")).drop("__k")
    return total


def matches_by_label(entities: DataFrame, truth: DataFrame, label: str = "cty", left: str = "i1") -> DataFrame:
    """Per label: entities, share without a match, mean, median and 99th percentile of matches, whether any or all have one."""
    per = entities.select(left, label).join(truth.groupBy(left).agg(F.count("*").alias("k")), left, "left").na.fill(0, ["k"])
    return per.groupBy(label).agg(
        F.count("*").alias("n"),
        F.avg((F.col("k") == 0).cast("double")).alias("share_single"),
        F.avg("k").alias("mean_k"),
        F.median("k").alias("median_k"),
        F.percentile("k", 0.99).alias("p99_k"),
        F.bool_or(F.col("k") > 0).alias("any_match"),
        F.bool_and(F.col("k") > 0).alias("all_match"),
    )


def density_sample(
    left: DataFrame, right: DataFrame, truth: DataFrame, low: float, high: float, left_id: str = "i1", right_id: str = "i23"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, records, truth pairs) of a range of the hash: matched records with their entity, unmatched ones by their own hash.

    So the sample has as many distractors for each entity as the whole.
    """
    within = lambda c: (share(F.col(c)) >= low) & (share(F.col(c)) < high)
    own = left.where(within(left_id))
    pairs = truth.join(own.select(left_id), left_id, "left_semi")
    matched = right.join(pairs.select(right_id), right_id, "left_semi")
    single = right.join(truth.select(right_id), right_id, "left_anti").where(within(right_id))
    return own, matched.unionByName(single), pairs


def leave_one_out(rows: DataFrame, groups: list[str], label: str, fit: Callable, measure: Callable) -> DataFrame:
    """One row a group: ``measure`` of its rows scored by a model of all others; ``fit``: rows -> (rows, out) -> rows."""
    report = None
    for g in groups:
        model = fit(rows.where(F.col(label) != g))
        one = measure(model(rows.where(F.col(label) == g), "p_loo")).select(F.lit(g).alias(label), "*")
        report = one if report is None else report.unionByName(one)
    return report


def leave_one_out_together(rows: DataFrame, groups: list, label: str, fit: Callable, measure: Callable) -> DataFrame:
    """The report of ``leave_one_out`` by models that are fitted together and measured at once.

    ``fit``: (rows, groups) -> (rows, out) -> rows; ``measure``: rows -> one row for each of their labels.
    """
    scored = fit(rows, groups)(rows.where(F.col(label).isin(groups)), "p_loo")
    every = rows.sparkSession.createDataFrame([(g,) for g in groups], f"`{label}` {rows.schema[label].dataType.simpleString()}")
    return every.join(measure(scored), label, "left")


def ablation(rows: DataFrame, families: dict[str, list[str]], fit: Callable, measure: Callable) -> DataFrame:
    """(family, ...): ``measure`` of a model without each family of features, and of all; ``fit``: (rows, features) -> scorer."""
    every = [f for family in families.values() for f in family]
    report = None
    for name, family in {"": [], **families}.items():
        kept = [f for f in every if f not in family]
        one = measure(fit(rows, kept)(rows, "p_abl")).select(F.lit(name).alias("without"), "*")
        report = one if report is None else report.unionByName(one)
    return report


def companion_labels(pairs: DataFrame, truth: DataFrame, left: str = "i1", right: str = "i23") -> DataFrame:
    """Pairs of records (x, y) with ``same``: 1 if one entity owns both."""
    own = truth.select(F.col(right).alias("__r"), F.col(left).alias("__o")).distinct()
    x, y = own.withColumnsRenamed({"__r": "x", "__o": "__a"}), own.withColumnsRenamed({"__r": "y", "__o": "__b"})
    once = pairs.select("x", "y").distinct()
    owned = once.join(x, "x").join(y, "y").where("__a = __b").select("x", "y").distinct().withColumn("same", F.lit(1))
    return pairs.join(owned, ["x", "y"], "left").na.fill(0, ["same"])


def prune(edges: DataFrame, score: str, base: int = 5, floor: float = 0.002, left: str = "i1", right: str = "i23") -> DataFrame:
    """A cheap model's cut: the ``base`` best of each list, and all of at least ``floor``."""
    order = Window.partitionBy(left).orderBy(F.desc(score), F.col(right))
    return edges.withColumn("__r", F.row_number().over(order)).where((F.col("__r") <= base) | (F.col(score) >= floor)).drop("__r")
