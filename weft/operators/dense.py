"""Exact nearest neighbours by inner product inside a partition label, forward and reverse, and their union with lexical pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.blocking import top

#: Rows of one side that a task holds.
BLOCK = 4096


def similarities(left: DataFrame, right: DataFrame, k: int, least_k: int, left_id: str = "i1", right_id: str = "i23", label: str = "cty", block: int = BLOCK) -> DataFrame:
    """(label, i1, i23, dcos): of every cell of a grid of blocks, the ``k`` best of each left and ``least_k`` best of each right vector.

    Both sides: (label, id, v array<double>). Each block meets each block of
    the other side in a task of its own, so memory is bounded by the block
    size and only the best of a cell leave it; whoever is among the best of
    all is among the best of its cell.
    """
    counts = {"l": left.groupBy(label).agg(F.count("*").alias("n")), "r": right.groupBy(label).agg(F.count("*").alias("n"))}
    parts = counts["l"].select(label, F.ceil(F.col("n") / block).cast("int").alias("nl")).join(
        counts["r"].select(label, F.ceil(F.col("n") / block).cast("int").alias("nr")), label
    )

    def spread(rows: DataFrame, key: str, own: str, other: str, mine: str, its: str) -> DataFrame:
        placed = rows.select(label, F.col(key).alias("id"), "v").join(F.broadcast(parts), label)
        return placed.withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(
            its, F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        ).select(label, "bl", "br", "id", "v")

    cells_l = spread(left, left_id, "nl", "nr", "bl", "br")
    # names of its own: both sides may come from one table
    cells_r = spread(right, right_id, "nr", "nl", "br", "bl").toDF("rl", "rbl", "rbr", "id", "v")
    kinds = dict(left.select(label, left_id).dtypes) | {right_id: dict(right.dtypes)[right_id]}

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({label: a.column(label)[:0], left_id: a.column("id")[:0], right_id: b.column("id")[:0], "dcos": pa.array([], pa.float64())})
        x = np.stack(a.column("v").to_numpy())
        y = np.stack(b.column("v").to_numpy())
        s = x @ y.T
        chosen = np.zeros(s.shape, bool)
        rows, columns = min(k, s.shape[1]), min(least_k, s.shape[0])
        # ties at the border stay in, the final ranks break them by id
        chosen |= s >= np.partition(s, s.shape[1] - rows, 1)[:, s.shape[1] - rows][:, None] - 1e-12
        if columns:
            chosen |= s >= np.partition(s, s.shape[0] - columns, 0)[s.shape[0] - columns][None] - 1e-12
        i, j = np.nonzero(chosen)
        return pa.table(
            {
                label: a.column(label).take(pa.array(i)),
                left_id: a.column("id").take(pa.array(i)),
                right_id: b.column("id").take(pa.array(j)),
                "dcos": pa.array(s[i, j]),
            }
        )

    found = cells_l.groupBy(label, "bl", "br").cogroup(cells_r.groupBy("rl", "rbl", "rbr")).applyInArrow(
        run, f"{label} {kinds[label]}, {left_id} {kinds[left_id]}, {right_id} {kinds[right_id]}, dcos double"
    )
    return found


def forward_reverse(found: DataFrame, k: int = 20, rev_k: int = 3, left: str = "i1", right: str = "i23", label: str = "cty", digits: int = 6) -> DataFrame:
    """(label, i1, i23, dcos, drank, drev_rank): the best of either direction; null where a pair is not in one."""
    own = found.withColumn("dcos", F.round("dcos", digits))
    forward = top(own, [label, left], [F.desc("dcos"), F.col(right)], k, "drank")
    reverse = top(own, [label, right], [F.desc("dcos"), F.col(left)], rev_k, "drev_rank")
    keys = [label, left, right]
    return forward.join(reverse.withColumnRenamed("dcos", "__d"), keys, "full").withColumn("dcos", F.coalesce("dcos", "__d")).select(
        *keys, "dcos", "drank", "drev_rank"
    )


def add_dense(lexical: DataFrame, dense: DataFrame, k: int = 20, left: str = "i1", right: str = "i23", label: str = "cty") -> DataFrame:
    """Lexical pairs and dense ones of rank up to ``k`` or with a reverse hit; what a side lacks gets its fixed value."""
    own = dense.where((F.col("drank") <= k) | F.col("drev_rank").isNotNull())
    return (
        lexical.withColumn("in_blk", F.lit(1))
        .join(own, [label, left, right], "full")
        .withColumn("in_blk", F.coalesce("in_blk", F.lit(0)))
        .withColumn("dcos", F.coalesce("dcos", F.lit(-1.0)))
        .withColumn("drank", F.coalesce("drank", F.lit(99)))
        .withColumn("drev_rank", F.coalesce("drev_rank", F.lit(9)))
    )


def pool(lexical: DataFrame, dense: DataFrame, k: int = 20, left: str = "i1", right: str = "i23") -> DataFrame:
    """Lexical candidates with their dense ranks, and the pairs that only dense search found, with the size of the joint list.

    Dense pairs are those of rank up to ``k`` or with a reverse hit; what a side
    lacks stays null, but for ``in_lexical``, ``n_passes`` and ``p6`` of dense-only pairs, which are 0.
    """
    own = dense.where((F.col("drank") <= k) | F.col("drev_rank").isNotNull())
    both = lexical.withColumn("in_lexical", F.lit(1)).join(own, [left, right], "full")
    for c in {"n_passes", "p6"} & set(both.columns):
        both = both.withColumn(c, F.when(F.col("in_lexical").isNull(), F.lit(0)).otherwise(F.col(c)))
    both = both.withColumn("in_lexical", F.coalesce("in_lexical", F.lit(0)))
    sizes = both.groupBy(left).agg(F.count("*").alias("n_cand"))
    return both.drop("n_cand").join(sizes, left)


def filled(pooled: DataFrame, k: int = 20) -> DataFrame:
    """Dense columns as features: similarity -1, rank k + 1 and reverse rank 9 where a pair was not found."""
    return pooled.withColumns(
        {"dcos": F.coalesce("dcos", F.lit(-1.0)), "drank": F.coalesce("drank", F.lit(k + 1)), "drev_rank": F.coalesce("drev_rank", F.lit(9))}
    )
