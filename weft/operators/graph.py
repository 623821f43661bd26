"""Graphs: connected components, capped clusters, their features, exact assignment of small components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import product
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _checkpoints(spark: SparkSession) -> None:
    """Use the folder the cluster names; one below the warehouse where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints-{uuid.uuid4().hex}")


def cut(rows: DataFrame) -> DataFrame:
    """The rows by a reliable checkpoint: computed once, with a lineage of their own."""
    _checkpoints(rows.sparkSession)
    return rows.checkpoint()


def saved(rows: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows written below the checkpoint folder as Parquet and read again: few bytes, for tables that are read many times."""
    spark = rows.sparkSession
    _checkpoints(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    schema = rows.schema
    rows.write.option("compression", compression).parquet(path.toString())
    return spark.read.schema(schema).parquet(path.toString())


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """In the jobs started inside, tables are broadcast by the size of what was shuffled, not by that of files: copies compress to a hundredth."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (static, adaptive)}
    spark.conf.set(adaptive, before[adaptive] or spark.conf.get(static))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, comp): the smallest node that can be reached, for every node of the edges.

    All nodes of a label take over the smallest label next to any of them, and
    labels of labels are followed (so rounds grow with the logarithm of the
    longest path), until nothing changes; every round's labels are written and
    read again. A checkpoint would keep the estimated size of its plan, which
    for a join is the product of both sides': a number with twice the digits
    every round, on the driver.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).unionByName(edges.select(F.col(v).alias("a"), F.col(u).alias("b")))
    both = saved(both.where("a is not null and b is not null").distinct())
    # not compressed: whether the labels are broadcast later goes by their files
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "none")
    with measured_joins(spark):
        while True:
            seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m")).withColumnRenamed("a", "node")
            near = labels.join(seen, "node").groupBy("comp").agg(F.min("m").alias("m"))
            # the label of a node's label is at most its label
            jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("j"))
            step = near.join(jump, "comp").select("comp", F.least("m", "j").alias("to")).where("to < comp")
            new = saved(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"), F.col("to").isNotNull().alias("moved")), "none")
            labels = new.select("node", "comp")
            if not new.where("moved").limit(1).count():
                return labels


def clusters(links: DataFrame, cap: int = 8, levels: tuple = (0.95, 0.98, 0.99, 0.995), x: str = "x", y: str = "y", p: str = "p_link") -> DataFrame:
    """(node, comp) of components of strong links; those over ``cap`` are built anew at the next level, at last left single."""
    done, rest = None, links
    for level in levels:
        own = components(rest.where(F.col(p) >= level), x, y)
        sizes = own.groupBy("comp").agg(F.count("*").alias("n"))
        fine = own.join(sizes.where(F.col("n") <= cap), "comp", "left_semi")
        done = fine if done is None else done.unionByName(fine)
        large = own.join(sizes.where(F.col("n") > cap), "comp", "left_semi").select(F.col("node").alias(x))
        rest = rest.join(large, x, "left_semi")
    return done


def cluster_features(edges: DataFrame, clustered: DataFrame, p: str = "p", left: str = "i1", right: str = "i23") -> DataFrame:
    """Per (left, comp): size, sum, best, second best, mean and deviation of the scores; records without a cluster are their own."""
    own = _in_clusters(edges, clustered, left, right)
    place = F.row_number().over(Window.partitionBy(left, "comp").orderBy(F.desc(p), F.col(right)))
    return own.withColumn("__r", place).groupBy(left, "comp").agg(
        F.count("*").alias("n"),
        F.sum(p).alias("p_sum"),
        F.max(p).alias("p_max"),
        # with one record the second best is the best
        F.coalesce(F.max(F.when(F.col("__r") == 2, F.col(p))), F.max(p)).alias("p_second"),
        F.avg(p).alias("p_mean"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("p_std"),
    )


def _in_clusters(edges: DataFrame, clustered: DataFrame, left: str, right: str) -> DataFrame:
    return edges.join(clustered.withColumnRenamed("node", right), right, "left").withColumn("comp", F.coalesce("comp", F.col(right)))


def cluster_family(
    edges: DataFrame, clustered: DataFrame, links: DataFrame, best: dict[str, str], second_source: Column, soft: float = 0.5,
    p: str = "p", left: str = "i1", right: str = "i23",
) -> DataFrame:
    """The edges with their cluster's features in their list.

    Size of the cluster, its records in the list and whether they are of both
    sources, the best other score, mean and deviation, the best value of each
    column of ``best``, and by soft links (left, x, y, p_link): the best
    inherited score, their number and the strongest.
    """
    own = _in_clusters(edges.withColumn("__s", second_source.cast("int")), clustered, left, right)
    size = clustered.groupBy("comp").agg(F.count("*").alias("cl_size"))
    base = cluster_features(edges, clustered, p, left, right)
    more = own.groupBy(left, "comp").agg(F.sum("__s").alias("__s3"), *[F.max(c).alias(f"cl_best_{n}") for n, c in best.items()])
    ways = links.where(F.col("p_link") >= soft)
    both = ways.select(left, F.col("x").alias(right), F.col("y").alias("__m"), "p_link").unionByName(
        ways.select(left, F.col("y").alias(right), F.col("x").alias("__m"), "p_link")
    )
    mates = edges.select(left, F.col(right).alias("__m"), F.col(p).alias("__p"))
    linked = both.join(mates, [left, "__m"]).groupBy(left, right).agg(
        F.max(F.col("p_link") * F.col("__p")).alias("cl_inherit"), F.count("*").alias("cl_soft_n"), F.max("p_link").alias("cl_link_max")
    )
    rows = own.join(base, [left, "comp"]).join(more, [left, "comp"]).join(size, "comp", "left").join(linked, [left, right], "left")
    other = F.when(F.col("n") <= 1, F.lit(-1.0)).when(F.col(p) >= F.col("p_max"), F.col("p_second")).otherwise(F.col("p_max"))
    return rows.select(
        left,
        right,
        F.coalesce("cl_size", F.lit(1)).alias("cl_size"),
        F.col("n").alias("cl_in_list"),
        ((F.col("__s3") > 0) & (F.col("__s3") < F.col("n"))).cast("int").alias("cl_src_mix"),
        other.alias("cl_p_max_other"),
        F.col("p_mean").alias("cl_p_mean"),
        F.col("p_std").alias("cl_p_std"),
        *[f"cl_best_{n}" for n in best],
        F.coalesce("cl_inherit", F.lit(0.0)).alias("cl_inherit"),
        F.coalesce("cl_soft_n", F.lit(0)).alias("cl_soft_n"),
        F.coalesce("cl_link_max", F.lit(0.0)).alias("cl_link_max"),
    )


def sizes(edges: DataFrame, left: str = "i1", right: str = "i23") -> DataFrame:
    """(comp, n_left, n_right, n_edges) of the components of a bipartite graph."""
    tagged = saved(edges.select(F.concat(F.lit("a"), F.col(left).cast("string")).alias("u"), F.concat(F.lit("b"), F.col(right).cast("string")).alias("v")))
    labels = components(tagged)
    nodes = labels.groupBy("comp").agg(
        F.count_if(F.col("node").startswith("a")).alias("n_left"), F.count_if(F.col("node").startswith("b")).alias("n_right")
    )
    counted = tagged.join(labels, tagged["u"] == labels["node"]).groupBy("comp").agg(F.count("*").alias("n_edges"))
    with measured_joins(edges.sparkSession):
        return saved(nodes.join(counted, "comp"))


def _best_prefix(available: list[float], rest: float) -> float:
    """The largest expected F0.5 of the first k of an entity's available records; ``rest``: expected matches elsewhere."""
    ps = sorted(available, reverse=True)
    best, unseen, dist = prod(1 - q for q in ps) * math.exp(-rest), sum(ps) + rest, [1.0]
    for k, q in enumerate(ps, 1):
        dist = [(dist[t] if t < k else 0.0) * (1 - q) + (dist[t - 1] * q if t else 0.0) for t in range(k + 1)]
        unseen -= q
        best = max(best, sum(w * 5 * t / (5 * t + max(unseen, 0.0) + 4 * (k - t)) for t, w in enumerate(dist) if t))
    return best


def _value(owner: dict, lists: dict) -> float:
    """Sum of the entities' best expected F0.5 if each record is open to its owner alone (None: to nobody)."""
    total = 0.0
    for entity, ps in lists.items():
        own = [q for r, q in ps.items() if owner.get(r) == entity]
        total += _best_prefix(own, sum(ps.values()) - sum(own))
    return total


def assign(edges: pd.DataFrame, most: int = 256, most_shared: int = 40) -> pd.DataFrame:
    """Owners of one component's records; only records that several entities claim are to be decided.

    All their configurations are tried if there are at most ``most``; else best
    responses twice over, unless more than ``most_shared`` are shared: then
    each goes to its best claim. A record that one entity claims is its own.
    An entity is worth the best expected F0.5 of the first k of its records.
    """
    claims: dict = {}
    lists: dict = {}
    for a, b, q in zip(edges["i1"], edges["i23"], edges["p"], strict=True):
        claims.setdefault(b, []).append((q, a))
        lists.setdefault(a, {})[b] = q
    records = sorted(claims)
    options = {r: [a for _, a in sorted(claims[r], key=lambda c: (-c[0], c[1]))] for r in records}
    shared = [r for r in records if len(options[r]) > 1]
    owner = {r: options[r][0] for r in records}
    ways = prod(len(options[r]) + 1 for r in shared[:most_shared]) if len(shared) <= most_shared else most + 1
    if ways <= most:
        tried = (dict(zip(shared, o, strict=True)) for o in product(*[[*options[r], None] for r in shared]))
        owner |= max(tried, key=lambda o: _value({**owner, **o}, lists))
    elif len(shared) <= most_shared:
        for _ in range(2):
            for r in shared:
                part = {a: lists[a] for a in options[r]}
                owner[r] = max([*options[r], None], key=lambda a, r=r, part=part: _value({**owner, r: a}, part))
    rows = [(a, r, lists[a][r]) for r, a in owner.items() if a is not None]
    return pd.DataFrame(rows, columns=["i1", "i23", "p"])


def solve(edges: DataFrame, floor: float = 0.02, most: int = 256, most_shared: int = 40) -> DataFrame:
    """Exclusive edges (i1, i23, p): components with at most ``most_shared`` shared records by ``assign``, others by the best claim.

    A task gets the lists of one component in which a record is shared; they
    are as many as its entities have, which the shared records bound.
    """
    from weft.operators.decide import exclusive

    kept = edges.where(F.col("p") >= floor)
    claimed = kept.groupBy("i23").agg(F.count("*").alias("n")).where("n > 1").select("i23")
    disputed = kept.join(claimed, "i23", "left_semi")
    tagged = disputed.select(F.concat(F.lit("a"), F.col("i1").cast("string")).alias("u"), F.concat(F.lit("b"), F.col("i23").cast("string")).alias("v"))
    labels = components(tagged)
    counts = labels.where(F.col("node").startswith("b")).groupBy("comp").agg(F.count("*").alias("shared"))
    small = labels.where(F.col("node").startswith("a")).join(counts.where(F.col("shared") <= most_shared), "comp", "left_semi")
    own = kept.join(small, F.concat(F.lit("a"), F.col("i1").cast("string")) == F.col("node")).select("comp", "i1", "i23", "p")
    rest = kept.join(small.select(F.col("node").alias("__n")), F.concat(F.lit("a"), F.col("i1").cast("string")) == F.col("__n"), "left_anti")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return assign(frame, most, most_shared)

    kinds = dict(edges.dtypes)
    solved = own.groupBy("comp").applyInPandas(run, f"i1 {kinds['i1']}, i23 {kinds['i23']}, p double")
    return solved.unionByName(exclusive(rest))


def record_pairs(edges: DataFrame, most: int = 8, least: float = 0.05, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """(left, x, y), x < y: pairs of the ``most`` best records of each list."""
    from weft.operators.blocking import top

    best = top(edges.where(F.col(p) >= least), [left], [F.desc(p), F.col(right)], most).select(left, right)
    return best.withColumnRenamed(right, "x").join(best.withColumnRenamed(right, "y"), left).where("x < y")


__all__ = ["assign", "cluster_family", "cluster_features", "clusters", "components", "cut", "record_pairs", "saved", "sizes", "solve"]
