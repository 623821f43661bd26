"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut; the first piece takes the remainder, so all others are full). Each
bin is started by the longest piece left, and a subset-sum dynamic program
over the lengths still available, one bit per reachable sum, finds the
fullest feasible combination for the rest, which is then removed.

Only the number of pieces of each length matters to that search, at most
``capacity`` numbers at any corpus size; a combination found is taken as
often as the counts allow, so every round uses up some length and the plan
has at most ``capacity`` combinations. Pieces get their places by rank
among the pieces of their length: ranks are given inside each task while
tokenizing, and shifted by the counts of earlier tasks, so a length that
half of all documents share is never gathered in one place.

Edge cases: null text counts as empty (one piece, the end id); repeated
rows and null ids are packed like any other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm import tokens
from weft.llm.common import Workspace, bounded_batches, trim

CAPACITY = 1024


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` > 0 tokens."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    Bit s of ``reach`` is set if some combination sums to s. Copies of a
    length enter in groups of 1, 2, 4, ..., and each group's earlier bits are
    kept to walk back from the best sum.
    """
    reach, limit, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left and not reach & goal:
            group = min(group, left)
            new = reach | reach << (length * group) & limit
            if new != reach:
                steps.append((length, group, reach))
                reach = new
            left -= group
            group *= 2
        if reach & goal:
            break
    best, used = reach.bit_length() - 1, {}
    for length, group, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + group
            best -= length * group
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: copies}) of every combination, in the order taken."""
    left = {x: n for x, n in counts.items() if n}
    found = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        found.append((times, used))
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return found


def _slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies a bin, first bin, offset of the first copy)."""
    rows, taken, bins = [], dict.fromkeys(counts, 0), 0
    for times, used in plan(counts, capacity):
        at = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            rows.append((length, taken[length], taken[length] + k * times, k, bins, at))
            taken[length] += k * times
            at += k * length
        bins += times
    return rows


def pieces(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept: int = tokens.CUTS_KEPT,
    size: int = tokens.GROUP_BYTES,
) -> DataFrame:
    """Every piece with its task and its rank among that task's pieces of its length.

    ``kept``: cuts a worker remembers; ``size``: bytes of texts that it looks up together.
    """
    bounded_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokens.ids(path, kept), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in tokens.grouped(batches, size):
            texts = batch.column(1).fill_null("")
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for at, ids in enumerate(encoder.encode(texts)):
                ids += end
                for p, (s, n) in enumerate(cut(len(ids) >> 2, capacity)):
                    row.append(at)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s << 2 : (s + n) << 2]))
                    rank.append(r := seen.get(n, 0))
                    seen[n] = r + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                names=[id_col, "piece", "start", "length", "ids_crc32", "task", "rank"],
            )
            trim()

    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    work: Workspace | None = None,
    kept: int = tokens.CUTS_KEPT,
    size: int = tokens.GROUP_BYTES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset in that sequence."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "packing")
    # written before ranks are used: a task that ran again would commit once
    found = work.save(pieces(docs, path, end_id, capacity, id_col, text_col, kept, size), "pieces")
    per_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    totals = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    kind = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("length", "lo", "hi", "copies", "bin", "at")]
    )
    # at most `capacity` combinations of at most sqrt(2 * capacity) distinct lengths
    slots = spark.createDataFrame(_slots(totals, capacity), kind)
    placed = (
        found.join(shifts, ["task", "length"])
        .withColumn("r", F.col("rank") + F.col("shift"))
        .join(F.broadcast(slots), "length")
        .where("r >= lo and r < hi")
    )
    return placed.select(
        id_col,
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("bin + (r - lo) div copies").alias("sequence_id"),
        F.expr("at + (r - lo) % copies * length").alias("offset"),
    )
