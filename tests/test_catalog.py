"""Every registered query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from weft.plans import catalog, extended  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return str(v) if hasattr(v, "isoformat") else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    found = catalog.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    answer = duck.execute(catalog.ORACLE_SQL[name])
    named = [c[0] for c in answer.description]
    assert sorted(named) == columns
    order = [named.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in answer.fetchall()]
    assert plain([tuple(r[c] for c in columns) for r in found.collect()]) == plain(want)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 40
    assert set(e.oracle_sql()) <= set(e.queries())
