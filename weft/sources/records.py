"""Record tables: TSV scans, ground truth, and the driver tables seen as records and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")]
)
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated text as it stands: no quoting, no types, no missing-value words; absent fields are empty."""
    rows = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("escape", "")
        .option("nullValue", "\x00")
        .option("emptyValue", "")
        .csv(path)
    )
    return rows.na.fill("")


def partition_label(country: Column) -> Column:
    return F.lower(F.trim(country))


def load_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(reference records, the two noisy sources stacked), with partition label ``cty`` and source ``src``."""
    def one(n: int) -> DataFrame:
        rows = read_tsv(spark, f"{folder}/{split}_source{n}.tsv", RECORD)
        return rows.withColumn("cty", partition_label(F.col("country"))).withColumn("src", F.lit(f"S{n}"))

    return one(1), one(2).unionByName(one(3))


def id_pairs(lists: DataFrame, key: str, ids: str, left: str = "s1_id", right: str = "s23_id") -> DataFrame:
    """One row per id of a comma list; empty lists give none."""
    return lists.select(F.col(key).alias(left), F.explode(F.split(ids, ",")).alias(right)).where(F.col(right) != "")


def read_results(spark: SparkSession, folder: str, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, s23_id) pairs of a folder of id lists as ``sinks.write_tsv`` leaves it."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(ids, T.StringType())])
    return id_pairs(read_tsv(spark, folder, schema), key, ids)


def read_ids(spark: SparkSession, path: str, key: str = "entity_id") -> DataFrame:
    """The distinct ids in the first column of a tab-separated file, as ``id``."""
    return read_tsv(spark, path, T.StructType([T.StructField(key, T.StringType())])).select(F.col(key).alias("id")).where("id <> ''").distinct()


def smoke_sample(records: DataFrame, truth: DataFrame, key: str = "entity_id", parts: int = 40, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(one of ``parts`` of the reference records by hash, the truth pairs of those): a sampling operator."""
    kept = records.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)) == 0)
    return kept, truth.join(kept.select(F.col(key).alias("s1_id")), "s1_id", "left_semi")


# The driver tables.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, digits: int = 6) -> Column:
    """A double rounded as DuckDB rounds: the scaled double to the nearest whole number, halves away from zero.

    Spark's own ``round`` goes by the decimal digits of the unscaled double, so halves may fall to the other side.
    """
    scaled = value * 10.0**digits
    near = F.rint(scaled)
    return F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) / 2).otherwise(near) / 10.0**digits


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first sentence is the name, the rest the address, the language the label."""
    docs = table(spark, sf_dir, "documents").na.fill({"text": ""})
    return docs.select(
        F.col("doc_id").alias("entity_id"),
        F.substring_index("text", ".", 1).alias("business_name"),
        F.expr("substring(text, length(substring_index(text, '.', 1)) + 2)").alias("business_address"),
        F.col("lang").alias("cty"),
        "source",
    )


def scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bipartite graph: supplier ``i1``, order ``i23``, score ``p`` from the dearest line of the pair."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("i1"), F.col("l_orderkey").alias("i23")).agg(
        rounded(F.max("l_extendedprice") / 105000).alias("p")
    )
