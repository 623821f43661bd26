import random

import pytest
from pyspark.sql import functions as F

from weft.llm import common
from weft.llm.common import Ranges, Workspace


def dealt(spark, df, rows):
    """(key, range) of every row."""
    key = F.struct("id", F.xxhash64("text").alias("h")).alias("key")
    keys = df.select(key).groupBy("key").agg(F.count("*").alias("n"))
    ranges = Ranges(keys, Workspace(spark, "t"), rows)
    return [((r.id is not None, r.id, r.h), r.b) for r in ranges.of(df.select("id", key), "key", "b").select("id", "key.h", "b").collect()]


@pytest.mark.parametrize("coarse", [1000, 100])
def test_many_ranges_are_monotone_and_balanced(spark, monkeypatch, coarse):
    """Thousands of ranges, more than literals hold; ten thousand rows of one id are split by their texts."""
    monkeypatch.setattr(common, "COARSE", coarse)
    rng = random.Random(6)
    rows = [(i, "") for i in rng.sample(range(-(10**12), 10**12), 20_000)] + [(7, f"t{i}") for i in range(10_000)]
    rows += [(None, f"n{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = sorted(dealt(spark, df, 7), key=lambda r: (r[0][0], r[0][1] or 0, r[0][2]))
    numbers = [b for _, b in got]
    assert numbers == sorted(numbers) and len(set(numbers)) > 4000
    sizes = [numbers.count(b) for b in set(numbers[:8000])]
    assert max(sizes) < 100


def test_ids_of_any_type_that_has_an_order(spark):
    rows = [(f"id{i % 900}", f"t{i % 1800}") for i in range(2000)] + [(None, "x")] * 30
    got = sorted(dealt(spark, spark.createDataFrame(rows, "id string, text string"), 5), key=lambda r: (r[0][0], r[0][1] or "", r[0][2]))
    numbers = [b for _, b in got]
    assert numbers == sorted(numbers) and len(set(numbers)) > 200
    assert len({b for k, b in got if k[1] is None}) == 1, "equal values are never in two ranges"
    empty = spark.createDataFrame([], "id string, text string")
    assert dealt(spark, empty, 5) == []
