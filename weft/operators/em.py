"""Fellegi-Sunter weights: comparison levels, supervised and by expectation maximisation on level counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower edges of the levels of a banded field; level 0 is missing where a field can be.
BANDS = {
    "name_jw": ("n_jw_core", (0.75, 0.85, 0.92, 0.97, 0.999), False),
    "name_tset": ("n_tset", (60, 75, 88, 97, 100), False),
    "street": ("a_street_jacc", (1e-6, 0.5, 0.999), True),
    "nums": ("a_num_jacc", (1e-6, 0.5, 0.999), True),
    "addr_tset": ("a_tset", (50, 70, 85, 95), True),
    "dense": ("dcos", (0.80, 0.85, 0.90, 0.95, 0.98), True),
}
AGREEMENTS = {"house": "a_house", "postal": "a_postal", "unit": "a_unit", "region": "a_region", "loc": "a_loc", "legal": "n_legal"}
LEAST = 1e-4
#: Distinct level vectors that the driver takes.
MOST_VECTORS = 1_000_000


def banded(value: Column, edges: tuple, can_miss: bool = False) -> Column:
    """1 plus the number of edges reached; 0 if missing (negative)."""
    level = sum(((value >= e).cast("int") for e in edges), F.lit(1))
    return F.when(value < 0, F.lit(0)).otherwise(level) if can_miss else level


def agreed(value: Column) -> Column:
    """0 missing (negative), 1 different, 2 equal."""
    return F.when(value < 0, F.lit(0)).when(value > 0.5, F.lit(2)).otherwise(F.lit(1))


def levels(features: DataFrame) -> dict[str, Column]:
    """The comparison levels that the features allow."""
    found = {f: banded(F.col(c), e, m) for f, (c, e, m) in BANDS.items() if c in features.columns}
    return found | {f: agreed(F.col(c)) for f, c in AGREEMENTS.items() if c in features.columns}


@dataclass
class Weights:
    """m and u probabilities of each field's levels, and the prior of a match."""

    m: dict[str, list[float]]
    u: dict[str, list[float]]
    prior: float

    def field_weight(self, field: str) -> Column:
        """log2(m / u) of the level in the column ``field``."""
        values = F.array(*[F.lit(math.log2(a / b)) for a, b in zip(self.m[field], self.u[field], strict=True)])
        return F.get(values, F.col(field))

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows with a weight a field, their sum and the posterior probability of a match."""
        fields = list(self.m)
        rows = rows.withColumns({f"w_{f}": self.field_weight(f) for f in fields})
        total = sum((F.col(f"w_{f}") for f in fields), F.lit(0.0))
        logit = total * math.log(2) + math.log(self.prior / (1 - self.prior))
        clipped = F.least(F.greatest(logit, F.lit(-40.0)), F.lit(40.0))
        return rows.withColumn("weight", total).withColumn("posterior", 1 / (1 + F.exp(-clipped)))


def _probabilities(counts: np.ndarray) -> list[float]:
    counts = counts + 1.0
    return np.clip(counts / counts.sum(), LEAST, 1 - LEAST).tolist()


def counted(rows: DataFrame, fields: list[str], label: str | None = None) -> DataFrame:
    """Distinct level vectors with how many pairs (and how many true ones) have them.

    There are at most the product of the numbers of levels, whatever the number of pairs.
    """
    extra = [F.sum(F.col(label).cast("long")).alias("n_true")] if label else []
    return rows.groupBy(*fields).agg(F.count("*").alias("n"), *extra)


def _sums(fields: dict[str, int], weight: Column, name: str) -> list[Column]:
    """Sums of a weight by each level of each field, as columns of one aggregated row."""
    return [F.coalesce(F.sum(F.when(F.col(f) == k, weight)), F.lit(0.0)).alias(f"{name}_{f}_{k}") for f, n in fields.items() for k in range(n)]


def _read(row, fields: dict[str, int], name: str) -> dict[str, list[float]]:
    return {f: _probabilities(np.array([row[f"{name}_{f}_{k}"] for k in range(n)], float)) for f, n in fields.items()}


def supervised(rows: DataFrame, n_levels: dict[str, int], label: str = "y") -> Weights:
    """m and u from labelled pairs, each count plus one: one aggregated row."""
    y = F.col(label).cast("double")
    row = rows.agg(*_sums(n_levels, y, "m"), *_sums(n_levels, 1 - y, "u"), F.avg(y).alias("prior")).first()
    return Weights(_read(row, n_levels, "m"), _read(row, n_levels, "u"), float(np.clip(row["prior"] or 0.0, LEAST, 0.9)))


def fit(
    rows: DataFrame, n_levels: dict[str, int], start: Weights, rounds: int = 25, tolerance: float = 1e-6, most: int = MOST_VECTORS
) -> Weights:
    """Unlabelled pairs: expectation maximisation over the distinct level vectors, which Spark counts once.

    Up to ``most`` vectors the rounds run on the driver, beyond that each is one aggregated row of a Spark job.
    """
    table = counted(rows, list(n_levels))
    few = table.limit(most + 1).toPandas()
    if len(few) <= most:
        return fit_counts(few, n_levels, start, rounds, tolerance)
    table = table.persist(StorageLevel.DISK_ONLY)
    now, last = start, None
    for _ in range(rounds):
        logs = [
            sum((F.get(F.array(*[F.lit(math.log(p)) for p in side[f]]), F.col(f)) for f in n_levels), F.lit(math.log(prior)))
            for side, prior in ((now.m, now.prior), (now.u, 1 - now.prior))
        ]
        both = F.greatest(*logs) + F.log1p(F.exp(-F.abs(logs[0] - logs[1])))
        priced = table.withColumn("__b", both).withColumn("__w", F.exp(logs[0] - F.col("__b")) * F.col("n"))
        row = priced.agg(
            *_sums(n_levels, F.col("__w"), "m"), *_sums(n_levels, F.col("n") - F.col("__w"), "u"), F.sum("__w").alias("w"), F.sum("n").alias("total"),
            F.sum(F.col("__b") * F.col("n")).alias("ll"),
        ).first()
        likelihood = row["ll"] / row["total"]
        now = Weights(_read(row, n_levels, "m"), _read(row, n_levels, "u"), float(np.clip(row["w"] / row["total"], LEAST, 0.9)))
        if last is not None and abs(likelihood - last) < tolerance:
            break
        last = likelihood
    table.unpersist()
    return now


def fit_counts(table: pd.DataFrame, n_levels: dict[str, int], start: Weights, rounds: int = 25, tolerance: float = 1e-6) -> Weights:
    """The same of counted level vectors: the fields and ``n``."""
    fields = list(n_levels)
    n = table["n"].to_numpy(float)
    at = {f: table[f].to_numpy(int) for f in fields}
    now, last = start, None
    for _ in range(rounds):
        one = math.log(now.prior) + sum(np.log(now.m[f])[at[f]] for f in fields)
        two = math.log1p(-now.prior) + sum(np.log(now.u[f])[at[f]] for f in fields)
        both = np.logaddexp(one, two)
        w = np.exp(one - both) * n
        likelihood = float((both * n).sum() / n.sum())
        now = Weights(
            {f: _probabilities(np.bincount(at[f], w, n_levels[f])) for f in fields},
            {f: _probabilities(np.bincount(at[f], n - w, n_levels[f])) for f in fields},
            float(np.clip(w.sum() / n.sum(), LEAST, 0.9)),
        )
        if last is not None and abs(likelihood - last) < tolerance:
            break
        last = likelihood
    return now


def _split(rows: DataFrame, group: str, fields: list[str], label: str | None = None) -> dict:
    """{group's value: its counted level vectors} by one job; as many rows as groups times level vectors."""
    extra = [F.sum(F.col(label).cast("long")).alias("n_true")] if label else []
    table = rows.groupBy(group, *fields).agg(F.count("*").alias("n"), *extra).toPandas()
    return {k: part for k, part in table.groupby(group)}


def fit_by(rows: DataFrame, n_levels: dict[str, int], start: Weights, group: str, rounds: int = 25, tolerance: float = 1e-6) -> dict:
    """{group's value: weights}: expectation maximisation of each label (or fold) on its own."""
    fields = list(n_levels)
    return {k: fit_counts(part, n_levels, start, rounds, tolerance) for k, part in _split(rows, group, fields).items()}


def fit_without(rows: DataFrame, n_levels: dict[str, int], start: Weights, fold: str, rounds: int = 25, tolerance: float = 1e-6) -> dict:
    """{fold: weights of all other folds}: what a fold's own pairs are weighed by."""
    fields = list(n_levels)
    parts = _split(rows, fold, fields)
    found = {}
    for k in parts:
        others = [p for name, p in parts.items() if name != k]
        if others:
            merged = pd.concat(others).groupby(fields, as_index=False)["n"].sum()
            found[k] = fit_counts(merged, n_levels, start, rounds, tolerance)
    return found


def scored_by(rows: DataFrame, weights: dict, group: str) -> DataFrame:
    """The rows with weight and posterior by the weights of their group; rows of other groups have none."""
    found = None
    for k, w in weights.items():
        one = w.scored(rows.where(F.col(group) == k))
        found = one if found is None else found.unionByName(one)
    return found
