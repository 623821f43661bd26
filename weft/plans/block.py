"""Multi-pass blocking of parsed and enriched records: passes, reverse pass, duplicate mates, scorer, dense pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import blocking, context, graph

# Candidates kept and share of the pool that a key may have, of every pass.
TOP = {"p1": 30, "p2": 20, "p3": 20, "p5": 15, "p7": 20}
SHARE = {"p1": 2e-4, "p2": 2e-4, "p3": 5e-4, "p5": 2e-4, "p7": 2e-4, "rev": 1e-3}
REVERSE = 5


def _joined(a: Column, b: Column) -> Column:
    """Both values as one key; null if one is empty."""
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("|"), b))


def pass_keys() -> dict[str, dict[str, Column]]:
    """The key columns of every pass over a parsed and enriched record."""
    c = F.col
    first = F.coalesce(F.get(c("core"), F.lit(0)), F.lit(""))
    short = F.when((F.size("core") == 1) & (F.length("k_joined") <= 5), c("k_joined"))
    whole = {"kj": c("k_joined"), "sk": c("k_skel"), "tr": c("k_trans")}
    rare = {"n": c("core"), "n2": c("trade"), "s": c("k_sorted"), "m": c("k_meta"), "a": F.when(c("acr") != "", c("acr")).otherwise(short)}
    place = {"t": c("a_toks"), "b": blocking.bigram_keys(c("a_toks"))}
    return {
        "p1": {"g": blocking.gram_keys(c("k_joined")), "gu": blocking.gram_keys(c("url")), "u": c("url"), **whole},
        "p2": rare,
        "p3": {
            "an": c("anchor"),
            "ac": _joined(c("anchor"), first),
            "po": c("postal"),
            "pc": _joined(c("postal"), first),
            "hu": _joined(c("house"), c("unit")),
        },
        "p5": place,
        "p7": {**rare, **place},
        "rev": {**rare, **whole},
    }


def block(left: DataFrame, right: DataFrame, key: str = "id", label: str = "cty", mates: bool = True) -> DataFrame:
    """Candidate pairs (label, i1, i23) with every pass's score and rank, the reverse pass, mates and competition.

    One job for all labels: the label is a part of every join key. Equal
    scores are ordered by the smaller id.
    """
    a, b = left.withColumnRenamed(key, "i1"), right.withColumnRenamed(key, "i23")
    n_right = right.groupBy(label).agg(F.count("*").alias("n"))
    n_left = left.groupBy(label).agg(F.count("*").alias("n"))
    parts = pass_keys()
    found = {
        name: blocking.index_join(
            blocking.keys(a, "i1", parts[name], label),
            blocking.postings(blocking.keys(b, "i23", parts[name], label), n_right, SHARE[name], 20, label),
            k,
            "i1",
            "i23",
            label,
        )
        for name, k in TOP.items()
    }
    wide = blocking.union_passes(found, [label, "i1", "i23"])
    back = blocking.index_join(
        blocking.keys(b, "i23", parts["rev"], label),
        blocking.postings(blocking.keys(a, "i1", parts["rev"], label), n_left, SHARE["rev"], 20, label),
        REVERSE,
        "i23",
        "i1",
        label,
    ).select(label, "i1", "i23", F.col("score").alias("rev_score"), F.col("rank").alias("rev_rank"))
    wide = wide.join(back, [label, "i1", "i23"], "full").withColumn("p6", F.lit(0))
    ranks = [f"rank_{name}" for name in TOP]
    wide = wide.withColumn("best_rank", F.coalesce(F.least(*ranks, "rev_rank"), F.lit(1 << 20)))
    if mates:
        wide = graph.cut(wide)  # it is read three times below
        long_enough = F.when((F.size("core") >= 2) | (F.length("k_joined") >= 6), F.col("k_sorted")).otherwise("")
        groups = blocking.duplicate_groups(b, "i23", long_enough, label=label)
        seeded = (F.coalesce("n_passes", F.lit(0)) >= 2) | (F.least("rank_p1", "rank_p2") <= 3)
        new = blocking.add_mates(wide, groups, "i1", "i23", seeded, "best_rank", label=label).drop("rank")
        wide = wide.unionByName(new.withColumn("p6", F.lit(1)), allowMissingColumns=True)
    wide = blocking.filled(wide, TOP)
    return (
        wide.withColumn("n_passes", F.coalesce("n_passes", F.lit(0)))
        .withColumn("found_rev", F.col("rev_rank").isNotNull().cast("int"))
        .withColumn("lrev_rank", F.log1p(F.coalesce("rev_rank", F.lit(REVERSE + 1))))
        .withColumn("rev_score", F.coalesce("rev_score", F.lit(0.0)))
    )


FEATURES = [
    *[f"score_{p}" for p in TOP], *[f"lrank_{p}" for p in TOP], *[f"found_{p}" for p in TOP],
    "rev_score", "lrev_rank", "found_rev", "p6", "n_passes",
]


def scored(candidates: DataFrame, scorer: Callable[[DataFrame, str], DataFrame], most: int = 80, label: str = "cty") -> DataFrame:
    """The ``most`` best candidates of each record by a fitted scorer, with competition features of ``blk``."""
    rows = scorer(candidates, "blk")
    return context.competition(blocking.top(rows, [label, "i1"], [F.desc("blk"), F.col("i23")], most, "blk_place"), "blk")


def smallest_length(candidates: DataFrame, truth: DataFrame, lengths: tuple = (50, 60, 80), slack: float = 0.002, rank: str = "rank") -> DataFrame:
    """(n, completeness, chosen): completeness of lists cut at each length; the shortest within ``slack`` of the best is chosen."""
    hits = candidates.join(truth, ["i1", "i23"], "left_semi")
    total = truth.agg(F.count("*").alias("__n"))
    counts = hits.agg(*[F.count_if(F.col(rank) <= n).alias(f"n{n}") for n in lengths])
    rows = counts.join(F.broadcast(total)).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.col(f"n{n}") / F.col("__n")).alias("completeness")) for n in lengths])).alias("r")
    ).select("r.*")  # one row a length
    best = rows.agg(F.max("completeness").alias("__b"))
    near = rows.join(F.broadcast(best)).withColumn("__ok", F.col("completeness") >= F.col("__b") - slack)
    first = near.where("__ok").agg(F.min("n").alias("__m"))
    return near.join(F.broadcast(first)).select("n", "completeness", (F.col("n") == F.col("__m")).alias("chosen"))
