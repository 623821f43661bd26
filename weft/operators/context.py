"""Window features of a scored bipartite graph (i1, i23, p): competition, lists, adaptive list lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.blocking import top


def _list(left: str) -> Window:
    return Window.partitionBy(left)


def _ranked(side: str, score: str, other: str) -> Window:
    return Window.partitionBy(side).orderBy(F.desc(score), F.col(other))


def competition(edges: DataFrame, score: str = "blk", left: str = "i1", right: str = "i23") -> DataFrame:
    """Rank, size and gap to the best, seen from both sides of the graph; equal scores by the smaller id."""
    return (
        edges.withColumn(f"{score}_rank", F.row_number().over(_ranked(left, score, right)))
        .withColumn(f"{score}_gap", F.max(score).over(_list(left)) - F.col(score))
        .withColumn("n_cand", F.count("*").over(_list(left)))
        .withColumn(f"{score}_rev_rank", F.row_number().over(_ranked(right, score, left)))
        .withColumn("rev_n", F.count("*").over(_list(right)))
        .withColumn(f"{score}_rev_gap", F.max(score).over(_list(right)) - F.col(score))
    )


def rerank_features(edges: DataFrame, p: str = "p", left: str = "i1", right: str = "i23") -> DataFrame:
    """Context of an edge: its list, and the best other claim on its record (0 without one)."""
    over = Window.partitionBy(right)
    ranked = (
        edges.withColumn("r_i1", F.row_number().over(_ranked(left, p, right)))
        .withColumn("gap_i1", F.max(p).over(_list(left)) - F.col(p))
        .withColumn("n05_i1", F.count_if(F.col(p) >= 0.5).over(_list(left)))
        .withColumn("n09_i1", F.count_if(F.col(p) >= 0.9).over(_list(left)))
        .withColumn("psum_i1", F.sum(p).over(_list(left)))
        .withColumn("r_i23", F.row_number().over(_ranked(right, p, left)))
        .withColumn("n05_i23", F.count_if(F.col(p) >= 0.5).over(over))
        .withColumn("__n", F.count("*").over(over))
    )
    best = F.max(p).over(over)
    second = F.max(F.when(F.col("r_i23") == 2, F.col(p))).over(over)
    other = F.when(F.col("__n") == 1, F.lit(0.0)).when(F.col("r_i23") == 1, second).otherwise(best)
    return ranked.withColumn("comp", other).withColumn("p_minus_comp", F.col(p) - F.col("comp")).drop("__n")


def best_other(edges: DataFrame, p: str = "p", left: str = "i1", right: str = "i23", strong: float = 0.5) -> DataFrame:
    """For each edge the strongest other record of its list (``mate``, ``m_p``) and how many others are strong."""
    ranked = edges.withColumn("r", F.row_number().over(_ranked(left, p, right)))
    first = F.max(F.when(F.col("r") == 1, F.struct(F.col(right).alias("id"), F.col(p).alias("p")))).over(_list(left))
    second = F.max(F.when(F.col("r") == 2, F.struct(F.col(right).alias("id"), F.col(p).alias("p")))).over(_list(left))
    mate = F.when(F.col("r") == 1, second).otherwise(first)
    n = F.count_if(F.col(p) >= strong).over(_list(left)) - (F.col(p) >= strong).cast("int")
    return ranked.withColumn("mate", mate["id"]).withColumn("m_p", mate["p"]).withColumn("m_n_strong", n).drop("r")


def list_features(edges: DataFrame, p: str = "p", left: str = "i1", right: str = "i23") -> DataFrame:
    """Rank, running sum and running mass of a list in descending order of p."""
    order = _ranked(left, p, right)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        edges.withColumn("r", F.row_number().over(order))
        .withColumn("cum_p", F.sum(p).over(running))
        .withColumn("rest_p", F.sum(p).over(_list(left)) - F.col("cum_p"))
        .withColumn("n_list", F.count("*").over(_list(left)))
    )


def entropy_term(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -q * F.log(q) - (1 - q) * F.log(1 - q)


def adaptive_lists(
    edges: DataFrame, p: str = "p", left: str = "i1", right: str = "i23", base: int = 10, least: int = 5, most: int = 20, floor: float = 0.002
) -> DataFrame:
    """Lists cut to a length by their entropy and mass: sure lists are short, unsure ones long."""
    rows = (
        edges.withColumn("r", F.row_number().over(_ranked(left, p, right)))
        .withColumn("entropy", F.sum(entropy_term(F.col(p))).over(_list(left)))
        .withColumn("mass", F.count_if(F.col(p) >= 0.01).over(_list(left)))
    )
    m = F.when(F.col("entropy") < 0.05, least).when(F.col("entropy") > 1.0, most).otherwise(base)
    m = F.least(F.greatest(m, F.col("mass") + 2, F.lit(least)), F.lit(most))
    return rows.withColumn("m", m.cast("int")).where((F.col("r") <= F.col("m")) & ((F.col(p) >= floor) | (F.col("r") <= least)))


def score_spread(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Row-wise mean, deviation, least, largest, votes over 0.5 and disagreement of several models' scores (nulls left out)."""
    array = F.filter(F.array(*scores), lambda x: x.isNotNull())
    n = F.size(array)
    total = F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    square = F.aggregate(array, F.lit(0.0), lambda s, x: s + x * x)
    votes = F.size(F.filter(array, lambda x: x > 0.5))
    return rows.select(
        "*",
        mean.alias("unc_mean"),
        F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0))).alias("unc_std"),
        F.array_min(array).alias("unc_min"),
        F.array_max(array).alias("unc_max"),
        votes.alias("unc_votes"),
        ((votes > 0) & (votes < n)).cast("int").alias("unc_disagree"),
        n.alias("unc_present"),
    )


def uncertain(p: Column, low: float = 0.003, high: float = 0.997) -> Column:
    """The band of scores that later stages look at again."""
    return p.between(low, high)


def entity_features(edges: DataFrame, p: str = "p", left: str = "i1", right: str = "i23") -> DataFrame:
    """One row per entity for a model of empty lists: the three best scores (0 if absent), their sum, counts and list size."""
    best = top(edges, [left], [F.desc(p), F.col(right)], 3).groupBy(left).agg(
        *[F.coalesce(F.max(F.when(F.col("rank") == k, F.col(p))), F.lit(0.0)).alias(f"t{k}") for k in (1, 2, 3)]
    )
    counts = edges.groupBy(left).agg(
        F.sum(p).alias("psum"), F.count_if(F.col(p) >= 0.5).alias("n05"), F.count_if(F.col(p) >= 0.8).alias("n08"), F.count("*").alias("ncand")
    )
    return best.join(counts, left)


def mates(edges: DataFrame, p: str = "p", strong: float = 0.5, low: float = 0.003, high: float = 0.997, left: str = "i1", right: str = "i23") -> DataFrame:
    """(left, right, mate, m_p, m_n_strong) of the uncertain edges whose list has another strong record: the strongest such."""
    own = edges.withColumn("__r", F.row_number().over(_ranked(left, p, right)))
    best = own.where((F.col(p) >= strong) & (F.col("__r") <= 2)).select(left, F.col(right).alias("mate"), F.col(p).alias("m_p"), "__r")
    counts = edges.where(F.col(p) >= strong).groupBy(left).agg(F.count("*").alias("m_n_strong"))
    band = edges.where(uncertain(F.col(p), low, high)).select(left, right)
    found = band.join(best, left).where(F.col("mate") != F.col(right))  # at most two a list
    first = found.groupBy(left, right).agg(F.min(F.struct("__r", "mate", "m_p")).alias("f")).select(left, right, "f.mate", "f.m_p")
    return first.join(counts, left)


SINGLE = (
    "t1", "t2", "t3", "psum", "n05", "n08", "ncand", "blk_max", "npass_max", "f_core_s1_r", "f_core_s23_r", "f_addr_s1_r", "idf_sum", "a_len",
    "has_house",
)


def single_features(entities: DataFrame, edges: DataFrame, candidates: DataFrame, p: str = "p", left: str = "i1", right: str = "i23") -> DataFrame:
    """(left, the features of SINGLE) for a model of empty lists: scores of exclusive edges, blocking and the entity's own fields; absent is 0.

    ``entities`` has the columns from f_core_s1_r on, ``candidates``: (left, right, blk, n_passes).
    """
    scores = entity_features(edges, p, left, right).drop("ncand")
    blocked = candidates.groupBy(left).agg(F.count("*").alias("ncand"), F.max("blk").alias("blk_max"), F.max("n_passes").alias("npass_max"))
    rows = entities.join(scores, left, "left").join(blocked, left, "left")
    return rows.select(left, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SINGLE])


def closure(edges: DataFrame, wanted: DataFrame, known: DataFrame, rank: str = "blk_rev_rank", k: int = 3, left: str = "i1", right: str = "i23") -> DataFrame:
    """Edges of the wanted entities, with the ``k`` best claims on the records in any wanted or known list, less the known entities' own."""
    lists = edges.join(wanted.select(left).unionByName(known.select(left)).distinct(), left, "left_semi").select(right).distinct()
    rivals = edges.where(F.col(rank) <= k).join(lists, right, "left_semi")
    own = edges.join(wanted.select(left), left, "left_semi")
    return own.unionByName(rivals).dropDuplicates([left, right]).join(known.select(left), left, "left_anti")


__all__ = [
    "adaptive_lists", "best_other", "closure", "competition", "entity_features", "entropy_term", "list_features", "mates", "rerank_features", "score_spread", "single_features", "top", "uncertain",
]
