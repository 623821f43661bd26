"""Scores of edges are rounded as their SQL rounds them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from weft.plans import catalog, extended  # noqa: F401
from weft.sources import records as R

DIR = f"{DATA}/sf0.01"


def test_halves(spark):
    values = [0.2806255, 0.0631895, 303410.1 / 600000, 0.5, -0.2806255, -2.5e-6, 1e-7, 0.49999999999999994e-6, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["r"] for r in rows.select("i", R.rounded(F.col("v")).alias("r")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(str, found)) == list(map(str, want))


@pytest.mark.parametrize("name", ["expected_f_select", "prefix_values", "policy_features"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{DIR}/orders.parquet'")
    answer = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    want = sorted(answer.fetchall())
    found = sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, DIR).collect())
    assert len(found) == len(want)
    apart = [(a, b) for a, b in zip(found, want, strict=True) if any(abs(x - y) > 1e-9 for x, y in zip(a, b, strict=True))]
    assert not apart
