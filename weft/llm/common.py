"""Shared helpers: shared-folder tables, ranges of an order, hashing splits, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one Arrow batch handed to Python. A batch holds whole texts, so
#: the default of 10,000 rows could exceed both worker memory and Arrow's 2 GB.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is above it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: What workers remember between tasks, as functions that empty it.
_REMEMBERED: list[Callable[[], None]] = []


def remembered(clear: Callable[[], None]) -> None:
    """Let ``forget`` empty what a module keeps for a worker's next task."""
    _REMEMBERED.append(clear)


def forget() -> None:
    """Give back what this worker remembers for stages that are over; workers serve one stage after the other."""
    for clear in _REMEMBERED:
        clear()
    gc.collect()
    trim()


def trim() -> None:
    """Hand free memory of this worker back to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` for the jobs started inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and all runs in one process (tests), a folder
    below the warehouse is used instead; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weft"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one run, written below the shared folder.

    A written table cuts the lineage as a reliable checkpoint does: it
    survives the loss of any executor, is compressed, and is computed once.
    Without a ``root`` of its own the folder goes when the session's process
    ends; until then results that read it stay valid.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex[:12]}"
        if root is None:
            path = self._path("")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or with no name everything of this run."""
        path = self._path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0)).cast("int")


#: Most ranges of an order; beyond that many times ``rows`` rows, ranges grow.
MOST_RANGES = 1_000_000
#: Bounds that are searched as literals, and bounds below each of those.
COARSE = 1000


class Ranges:
    """Neighbouring ranges of the distinct values of a struct column ``key`` (of any types that can be ordered; nulls first).

    Every value is the first of a range with a probability of one in ``rows``
    for each of its ``n`` rows, by its hash: ranges hold about ``rows`` rows,
    however many there are, and no value is in two. Bounds are searched in two
    levels, ``COARSE`` literals and a table of at most ``MOST_RANGES`` values,
    which is broadcast.
    """

    def __init__(self, keys: DataFrame, work: Workspace, rows: int, name: str = "ranges"):
        total = keys.agg(F.sum("n")).first()[0] or 0
        rows = max(rows, -(-total // MOST_RANGES))
        chance = F.least(F.col("n"), F.lit(rows))
        picked = keys.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(rows)) < chance).select("key")
        # at most about MOST_RANGES rows
        place = F.row_number().over(Window.orderBy("key")) - 1
        self.bounds = work.save(picked.select("key", place.alias("place")), name)
        self.kind = keys.schema["key"].dataType
        self.two_levels = self.bounds.count() > COARSE
        first = self.bounds.where(F.col("place") % COARSE == 0) if self.two_levels else self.bounds
        self.coarse = [r["key"] for r in first.orderBy("place").select("key").collect()]  # at most COARSE or MOST_RANGES / COARSE

    def of(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """Add ``out``, the number of the range of each row's ``key``."""
        if not self.coarse:
            return df.withColumn(out, F.lit(0))
        fields = self.kind.fields
        literal = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in self.coarse])
        number = _bounds_up_to(literal, F.lit(len(self.coarse)), F.col(key), len(self.coarse))
        if not self.two_levels:
            return df.withColumn(out, number)
        fine = self.bounds.groupBy((F.expr(f"place div {COARSE}") + 1).cast("int").alias("__c")).agg(
            F.array_sort(F.collect_list("key")).alias("__fine")  # at most COARSE values
        )
        below = F.coalesce(_bounds_up_to(F.col("__fine"), F.size("__fine"), F.col(key), COARSE), F.lit(0))
        exact = F.when(F.col("__c") == 0, F.lit(0)).otherwise((F.col("__c") - 1) * COARSE + below)
        joined = df.withColumn("__c", number).join(F.broadcast(fine), "__c", "left")
        return joined.withColumn(out, exact.cast("int")).drop("__c", "__fine")


def _bounds_up_to(bounds: Column, n: Column, key: Column, most: int) -> Column:
    """How many of ``n`` ascending bounds (at most ``most``) are not above the key, by bisection."""

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        open_ = s["lo"] < s["hi"]
        right = open_ & (key >= F.get(bounds, F.least(mid, n - 1)))
        return F.struct(
            F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi")
        )

    state = F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length()))), state, step)["lo"]


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of the edge table (u, v); root is the smallest node reachable.

    Alternating large-star and small-star rounds: no neighbourhood is ever
    collected, each round is two partially aggregated minima and two joins
    that adaptive execution can split. Rounds grow with the logarithm of the
    longest path. Self-loops and repeated edges are ignored; nulls are dropped.
    """
    now = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now, step, last = work.save(now, f"{name}0"), 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        new = work.save(small, f"{name}{step}")
        work.drop(f"{name}{step - 1}")
        now = new
        mark = now.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.countDistinct("u").alias("d")
        ).first()
        if mark["n"] == mark["d"] and tuple(mark) == last:
            break
        last = tuple(mark)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
