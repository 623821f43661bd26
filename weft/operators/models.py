"""Scorers and calibrators on pyspark.ml: folds, out-of-fold scores, blocking scorer, isotonic curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLDS = 5


def fold(entity: Column, folds: int = FOLDS) -> Column:
    """All rows of an entity fall in one fold, the same at every run."""
    return F.pmod(F.xxhash64(entity), F.lit(folds)).cast("int")


def share(entity: Column) -> Column:
    """A number in [0, 1) from the id, for role ranges."""
    return F.pmod(F.xxhash64(entity, F.lit(7)), F.lit(1 << 40)) / float(1 << 40)


def role(entity: Column, ranges: dict[str, tuple[float, float]], rest: str = "context") -> Column:
    found = F.lit(rest)
    for name, (low, high) in ranges.items():
        found = F.when((share(entity) >= low) & (share(entity) < high), F.lit(name)).otherwise(found)
    return found


def _probability(rows: DataFrame, out: str) -> DataFrame:
    return rows.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).drop("probability", "rawPrediction", "prediction", "__x", "__raw")


def scorer(rows: DataFrame, features: list[str], label: str = "y", iterations: int = 100):
    """Standardised logistic regression; returns rows -> rows with ``out``."""
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
            LogisticRegression(featuresCol="__x", labelCol=label, maxIter=iterations, regParam=1e-4),
        ]
    ).fit(rows.withColumn(label, F.col(label).cast("double")))
    return lambda more, out="p": _probability(model.transform(more), out)


def scorers_without(rows: DataFrame, groups: list, by: str, features: list[str], label: str = "y", iterations: int = 100) -> Callable:
    """Logistic regressions, one for each group, fitted on the rows of all others; returns rows -> rows with ``out`` by their group's model.

    The models minimise what ``scorer`` minimises, by Newton's method: every pass over the rows gives the gradients and
    Hessians of all models at once (28 sums a model for five features), and a few passes reach the minimum.
    """
    place = F.array_position(F.array(*map(F.lit, groups)), F.col(by)) - 1
    # rows of other groups are in every model's share, rows without a group in none
    known = rows.where(F.col(by).isNotNull()).select(place.cast("int").alias("g"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double") for f in features])
    moments = known.groupBy("g").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)], F.count_if(sum((F.col(f).isNull() | F.isnan(f)).cast("int") for f in features) > 0).alias("bad"),
    ).collect()
    if any(m["bad"] for m in moments):
        raise ValueError("features must not be null or NaN")
    d = len(features)
    g_of, n, pos = (np.array([m[c] for m in moments], float) for c in ("g", "n", "pos"))
    mean, var = (np.array([[m[f"{c}{i}"] for i in range(d)] for m in moments]).reshape(-1, d) for c in "mv")
    center = (n @ mean) / max(1, n.sum())
    spread = np.sqrt((n @ (var + (mean - center) ** 2)) / max(1, n.sum()))
    spread[spread == 0] = 1
    models = []
    for k, g in enumerate(groups):
        own = n * (g_of != k)
        total, hits = own.sum(), pos[g_of != k].sum()
        if not total:
            raise ValueError(f"no rows without the group {g}")
        m = own @ mean / total
        # sample variances, in units of the common spread, weigh the penalty
        weight = own @ (var + (mean - m) ** 2) / max(1, total - 1) / spread**2
        models.append(_Newton(k, total, hits, weight))
    for _ in range(iterations):
        live = [m for m in models if not m.done]
        if not live:
            break
        sums = np.sum([r["s"] for r in known.mapInArrow(_sums(live, center, spread), "s array<double>").collect()], axis=0).reshape(len(live), -1)
        for m, own in zip(live, sums, strict=True):
            m.step(own)

    def apply(more: DataFrame, out: str = "p") -> DataFrame:
        score = F.lit(None).cast("double")
        for g, m in zip(groups, models, strict=True):
            eta = sum(((F.col(f) - float(c)) / float(s) * float(b) for f, b, c, s in zip(features, m.best[1:], center, spread, strict=True)), F.lit(float(m.best[0])))
            score = F.when(F.col(by) == g, 1 / (1 + F.exp(-eta))).otherwise(score)
        return more.withColumn(out, score)

    return apply


class _Newton:
    """One model's minimum of (mean log loss + penalty / 2 * sum of weighted squares), a step a call; steps that do not descend are halved."""

    def __init__(self, group: int, n: float, hits: float, weight: np.ndarray, penalty: float = 1e-4):
        self.group, self.n, self.weight = group, n, np.concatenate([[0.0], penalty * weight])
        # features that do not vary have no weight, and keep the coefficient 0
        self.free = np.concatenate([[True], weight > 0])
        self.best = np.zeros(len(weight) + 1)
        # labels of one kind have no finite minimum
        self.done = hits in (0, n)
        self.best[0] = np.log(hits) - np.log(n - hits) if not self.done else (np.inf if hits else -np.inf)
        self.at, self.loss, self.move = self.best, np.inf, None

    def step(self, sums: np.ndarray) -> None:
        """``sums`` at ``at``: the loss, the gradient, the Hessian by rows."""
        d = len(self.best)
        loss = sums[0] / self.n + (self.weight * self.at**2).sum() / 2
        if loss > self.loss + 1e-13:
            self.move = self.move / 2
        else:
            self.best, self.loss = self.at, loss
            gradient = (sums[1 : 1 + d] / self.n + self.weight * self.at)[self.free]
            hessian = (sums[1 + d :].reshape(d, d) / self.n + np.diag(self.weight))[np.ix_(self.free, self.free)]
            self.move = np.zeros(d)
            self.move[self.free] = -np.linalg.solve(hessian, gradient)
        self.at = self.best + self.move
        self.done = bool(np.abs(self.move).max() < 1e-9)


def _sums(models: list[_Newton], center: np.ndarray, spread: np.ndarray) -> Callable:
    """Batches of (group, label, features) -> one row a task: each model's sums at its point over the rows of other groups."""
    points = [(m.group, m.at) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(center) + 1
        totals = np.zeros((len(points), 1 + d + d * d))
        for batch in batches:
            group, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.empty((d, batch.num_rows))
            x[0] = 1
            for i in range(d - 1):
                x[i + 1] = (batch.column(i + 2).to_numpy() - center[i]) / spread[i]
            for total, (own, at) in zip(totals, points, strict=True):
                others = group != own
                eta = at @ x
                tail = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1, tail) / (1 + tail)
                total[0] += ((np.maximum(eta, 0) + np.log1p(tail) - y * eta) * others).sum()
                total[1 : 1 + d] += x @ ((p - y) * others)
                total[1 + d :] += ((x * (p * (1 - p) * others)) @ x.T).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([totals.ravel()], pa.list_(pa.float64()))], names=["s"])

    return run


def monotone(rows: DataFrame, features: list[str], rising: list[str], label: str = "y", iterations: int = 100):
    """Logistic regression in which some features can only raise the score."""
    low = [0.0 if f in rising else -1e6 for f in features]
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="__x"),
            LogisticRegression(
                featuresCol="__x", labelCol=label, maxIter=iterations, lowerBoundsOnCoefficients=Matrices.dense(1, len(features), low)
            ),
        ]
    ).fit(rows.withColumn(label, F.col(label).cast("double")))
    return lambda more, out="p": _probability(model.transform(more), out)


def boosted(rows: DataFrame, features: list[str], label: str = "y", trees: int = 20, depth: int = 4):
    """Gradient-boosted trees."""
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="__x"),
            GBTClassifier(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, seed=0),
        ]
    ).fit(rows.withColumn(label, F.col(label).cast("double")))
    return lambda more, out="p": _probability(model.transform(more), out)


def out_of_fold(rows: DataFrame, entity: str, fit, out: str = "p_oof", folds: int = FOLDS) -> DataFrame:
    """Scores of every row by a model fitted without its entity's fold; ``fit``: rows -> (rows, out) -> rows."""
    marked = rows.withColumn("__fold", fold(F.col(entity), folds))
    parts = None
    for k in range(folds):
        model = fit(marked.where(F.col("__fold") != k))
        own = model(marked.where(F.col("__fold") == k), out)
        parts = own if parts is None else parts.unionByName(own)
    return parts.drop("__fold")


def isotonic(rows: DataFrame, p: str = "p", y: str = "y"):
    """A monotone curve from scores to rates; scores beyond the fitted ones keep the end values."""
    ends = rows.agg(F.min(p).alias("low"), F.max(p).alias("high")).first()
    model = IsotonicRegression(featuresCol="__p", labelCol="__y").fit(rows.select(F.col(p).alias("__p"), F.col(y).cast("double").alias("__y")))

    def apply(more: DataFrame, out: str = "p_cal") -> DataFrame:
        clipped = F.least(F.greatest(F.col(p), F.lit(ends["low"])), F.lit(ends["high"]))
        return model.transform(more.withColumn("__p", clipped)).withColumnRenamed("prediction", out).drop("__p")

    return apply


def cross_isotonic(rows: DataFrame, entity: str, p: str = "p", y: str = "y", out: str = "p_cal") -> DataFrame:
    """Every row calibrated by a curve fitted without its entity's fold."""
    return out_of_fold(rows, entity, lambda kept: isotonic(kept, p, y), out)


def auc(rows: DataFrame, p: str = "p", y: str = "y", bands: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by the counts of each score in [0, 1], of all rows or of those of each ``by``: ties count half.

    Scores are dealt to ``bands`` of equal width: negatives below a score are
    those of lower bands, and those below it in its own, so no task orders all.
    """
    counts = rows.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    counts = counts.withColumn("band", F.least(F.greatest(F.floor(F.col("p") * bands), F.lit(0)), F.lit(bands - 1)))
    totals = counts.groupBy(*by, "band").agg(F.sum("neg").alias("all"))  # at most `bands` rows each
    before = Window.partitionBy(*by).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    lower = totals.select(*by, "band", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("lower"))
    below = Window.partitionBy(*by, "band").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.join(F.broadcast(lower), [*by, "band"]).withColumn("under", F.col("lower") + F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return summed.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def early_stopped(rows: DataFrame, features: list[str], held: Column, label: str = "y", trees: int = 100, depth: int = 4):
    """(boosted trees that stop when the held rows no longer gain, their number)."""
    marked = rows.withColumn(label, F.col(label).cast("double")).withColumn("__held", held)
    gbt = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, seed=0, validationIndicatorCol="__held", validationTol=0.001)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), gbt]).fit(marked)
    return (lambda more, out="p": _probability(model.transform(more), out)), model.stages[-1].getNumTrees


def final_length(best: list[int], least: int = 50, factor: float = 1.1) -> int:
    """Rounds of the model of all rows: a little more than the folds needed."""
    return max(least, int(factor * sum(best) / max(1, len(best))))
