"""Models without each group, fitted together: equal to models fitted one by one, in few passes."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weft.operators import models, studies

FEATURES = ["u", "v", "same"]


def made(spark, rows=3000, groups="abc"):
    rng = np.random.default_rng(3)
    u, v = rng.normal(5, 2, rows), rng.exponential(100, rows)
    y = rng.random(rows) < 1 / (1 + np.exp(-(u - 5) + v / 200))
    return spark.createDataFrame(
        [(groups[i % len(groups)], float(a), float(b), 7.0, int(t)) for i, (a, b, t) in enumerate(zip(u, v, y, strict=True))],
        "cty string, u double, v double, same double, y int",
    ).repartition(5)


def test_equal_to_models_fitted_one_by_one(spark):
    rows = made(spark)
    found = models.scorers_without(rows, list("abc"), "cty", FEATURES)(rows, "p").select("cty", "u", "p")
    for g in "abc":
        kept = rows.where(F.col("cty") != g).withColumn("y", F.col("y").cast("double"))
        fitted = Pipeline(
            stages=[
                VectorAssembler(inputCols=FEATURES, outputCol="raw"),
                StandardScaler(inputCol="raw", outputCol="x", withMean=True),
                LogisticRegression(featuresCol="x", labelCol="y", maxIter=500, regParam=1e-4, tol=1e-14),
            ]
        ).fit(kept)
        want = fitted.transform(rows.where(F.col("cty") == g)).select("u", F.get(vector_to_array("probability"), F.lit(1)).alias("want"))
        assert found.where(F.col("cty") == g).join(want, "u").agg(F.max(F.abs(F.col("p") - F.col("want")))).first()[0] < 1e-6


def test_few_passes(spark, monkeypatch):
    """Every model took up to a hundred passes of its own."""
    passes, old = [], models._sums
    monkeypatch.setattr(models, "_sums", lambda *a: passes.append(1) or old(*a))
    models.scorers_without(made(spark), list("abc"), "cty", FEATURES)
    assert 2 <= len(passes) <= 12


def test_report_by_group(spark):
    rows = made(spark)
    fit = lambda kept, groups: models.scorers_without(kept, groups, "cty", FEATURES)
    found = studies.leave_one_out_together(rows, ["a", "b", "c", "none"], "cty", fit, lambda own: models.auc(own, "p_loo", by=("cty",)))
    got = {r["cty"]: r["auc"] for r in found.collect()}
    one = lambda kept: models.scorer(kept, FEATURES)
    want = {r["cty"]: r["auc"] for r in studies.leave_one_out(rows, list("abc"), "cty", one, lambda own: models.auc(own, "p_loo")).collect()}
    assert got.pop("none") is None and got == pytest.approx(want, abs=1e-4)


def test_one_kind_of_label(spark):
    rows = made(spark, 60).withColumn("y", F.when(F.col("cty") == "a", F.col("y")).otherwise(1))
    found = models.scorers_without(rows, list("abc"), "cty", FEATURES)(rows, "p")
    assert found.where("cty = 'a'").agg(F.min("p")).first()[0] == 1 and found.where("cty = 'b' and p is null").count() == 0
