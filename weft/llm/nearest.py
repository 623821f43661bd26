"""Approximate maximum inner product search with score-aware anisotropic quantisation.

Vectors are dealt to coarse cells (k-means). What is left of a vector after
its cell's centre, divided by the spread of the cell, is cut into subspaces of
two dimensions with sixteen centroids each, so a code has four bits. Codes and
centroids minimise a loss that weighs the part of the error parallel to the
vector ``ETA`` times the rest, as that part is what changes large inner
products: codes by coordinate descent over the subspaces, centroids by one
least-squares system over all of them. As codes are relative to the spread of
a cell, they order near copies as finely as far neighbours.

A query is searched in the cells with the largest expected best score: that
of the centre, and what a cell of its spread and size adds. How many, is
measured on the sample: as many as hold ``REACHED`` of the neighbours of
``TRIED`` of its vectors; few where vectors form groups, about half of the
cells where they point anywhere. A search adds up table entries of the codes
(two four-bit codes make one look-up), takes the ``KEPT`` best of a block and
scores those exactly on the original vectors in double precision.
``exact=True`` searches every cell and scores every vector instead.

Coarse centres (at most ``MOST_CELLS``, about half the root of the number of
vectors) and centroids are fitted on at most ``SAMPLE`` distinct vectors,
those with the smallest hash; every vector is indexed. Cells beyond ``ROWS``
vectors are split in blocks, the queries of a cell in parts of ``QUERIES``:
whatever the size of the table or of a hot cell, a task holds one block.
Queries meet the rows of their probed cells only, so work grows with the
number of queries times the size of a cell. Of equal vectors the smallest
k + 1 ids are candidates, which is all that any result can hold, and equal
queries are searched once.

Edge cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do those without an id or of another length
than the most common one (the larger of equals); rows that repeat an id
count once, the one with the smallest hash of its vector; equal scores are
ordered by the smaller id; a table without such vectors gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm.common import Workspace, bounded_batches

SAMPLE = 16384
ETA = 4.0
ROUNDS = 6
MOST_CELLS = 1024
#: Share of the sample's neighbours that the probed cells hold, and vectors of the sample that are asked.
REACHED, TRIED = 0.95, 512
ROWS = 8192
QUERIES = 1024
#: Candidates of a block that are scored exactly.
KEPT = 128


def _pad(x: np.ndarray) -> np.ndarray:
    """Dimensions filled up with zeros to a multiple of four: an even number of subspaces of two."""
    more = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, more))) if more else x


@dataclass
class Quantiser:
    """centroids: [subspace, 16, 2]; centres: [cell, padded dimensions]; spread: [cell], of a component around its centre."""

    centroids: np.ndarray
    centres: np.ndarray
    spread: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: that of the nearest centre."""
        x = _pad(np.asarray(x, np.float64))
        half = 0.5 * (self.centres**2).sum(1)
        out = [(half - x[at : at + 4096] @ self.centres.T).argmin(1) for at in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def parts(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([n, subspaces, 2] of what the codes stand for, the unit vectors of x likewise)."""
        x = _pad(np.asarray(x, np.float64))
        shape = (len(x), len(self.centroids), 2)
        left = (x - self.centres[cell]) / self.spread[cell][:, None]
        return left.reshape(shape), (x / np.linalg.norm(x, axis=1)[:, None]).reshape(shape)

    def encode(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 3) -> np.ndarray:
        """Codes [n, subspaces] of vectors by coordinate descent from the nearest centroids."""
        parts, unit = self.parts(x, cell)
        n, m = parts.shape[:2]
        if codes is None:
            codes = np.empty((n, m), np.uint8)
            for s in range(m):
                codes[:, s] = ((parts[:, s, None] - self.centroids[s]) ** 2).sum(2).argmin(1)
        along = np.empty((n, m))
        for s in range(m):
            along[:, s] = ((parts[:, s] - self.centroids[s][codes[:, s]]) * unit[:, s]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(m):
                rest = parts[:, s, None] - self.centroids[s]
                own = (rest * unit[:, s, None]).sum(2)
                cost = (rest**2).sum(2) + (ETA - 1) * ((total - along[:, s])[:, None] + own) ** 2
                codes[:, s] = best = cost.argmin(1)
                new = own[np.arange(n), best]
                total += new - along[:, s]
                along[:, s] = new
        return codes

    def tables(self, query: np.ndarray) -> np.ndarray:
        """[subspaces / 2, 256]: the inner products of a byte of two codes."""
        own = np.einsum("scd,sd->sc", self.centroids, _pad(query[None])[0].reshape(-1, 2)).astype(np.float32)
        return (own[0::2, None, :] + own[1::2, :, None]).reshape(len(own) // 2, 256)

    def probed(self, queries: np.ndarray, reach: np.ndarray, probes: int) -> np.ndarray:
        """[n, probes]: cells of the largest centre's score plus ``reach`` (of the cell) times the query's length."""
        q = _pad(np.asarray(queries, np.float64))
        scores = q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * reach
        return np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return codes[:, 0::2] | codes[:, 1::2] << 4


def centres_of(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """k-means of distinct vectors from random ones of them; a centre without vectors stays where it is."""
    centres = x[np.random.default_rng(0).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = Quantiser(np.zeros((0, 16, 2)), centres, np.ones(len(centres))).cells(x)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(x: np.ndarray, cells: int = 1) -> Quantiser:
    """Centres and centroids of a sample [n, d]; equal vectors count once."""
    x = _pad(np.unique(np.asarray(x, np.float64), axis=0))
    n, m = len(x), x.shape[1] // 2
    centres = centres_of(x, min(cells, n))
    own = Quantiser(np.zeros((m, 16, 2)), centres, np.ones(len(centres)))
    cell = own.cells(x)
    size = np.bincount(cell, minlength=len(centres))
    square = np.bincount(cell, ((x - centres[cell]) ** 2).sum(1), len(centres)) / np.maximum(size, 1) / x.shape[1]
    overall = max(float(np.sqrt(((x - centres[cell]) ** 2).mean())), 1e-12)
    # a cell of one sampled vector says nothing of its spread
    own.spread = np.where((size > 1) & (square > 0), np.sqrt(square), overall)
    parts, unit = own.parts(x, cell)
    rng = np.random.default_rng(0)
    centroids = parts[rng.integers(0, n, (m, 16)), np.arange(m)[:, None]]
    for _ in range(8):
        for s in range(m):
            near = ((parts[:, s, None] - centroids[s]) ** 2).sum(2).argmin(1)
            count = np.bincount(near, minlength=16)
            for d in range(2):
                mean = np.bincount(near, parts[:, s, d], 16) / np.maximum(count, 1)
                centroids[s, :, d] = np.where(count > 0, mean, centroids[s, :, d])
    own.centroids = centroids
    aim = (parts * unit).sum((1, 2))  # what the codes should give along the vector
    codes = None
    for _ in range(ROUNDS):
        codes = own.encode(x, cell, codes, 1)
        size = m * 32
        left, right = np.zeros((size, size)), np.zeros(size)
        at = (np.arange(m) * 32 + codes.astype(int) * 2)[:, :, None] + np.arange(2)  # unknowns of each vector
        for low in range(0, n, 1024):
            rows = slice(low, low + 1024)
            k = len(at[rows])
            u = np.zeros((k, size))
            np.put_along_axis(u, at[rows].reshape(k, -1), unit[rows].reshape(k, -1), 1)
            left += (ETA - 1) * (u.T @ u)
            right += (ETA - 1) * (u.T @ aim[rows])
        right += np.bincount(at.ravel(), parts.ravel(), size)
        left[np.diag_indices(size)] += np.bincount(at.ravel(), minlength=size) + 1e-9
        right += 1e-9 * own.centroids.ravel()
        own.centroids = np.linalg.solve(left, right).reshape(m, 16, 2)
    return own


def cells_needed(quantiser: Quantiser, x: np.ndarray, k: int, reach: np.ndarray) -> int:
    """The fewest probes that hold ``REACHED`` of the ``k`` nearest other vectors of a sample."""
    x = _pad(np.unique(np.asarray(x, np.float64), axis=0))
    cell = quantiser.cells(x)
    asked = np.random.default_rng(1).permutation(len(x))[:TRIED]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(reach)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = quantiser.probed(x[asked], reach, len(reach))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(reach)), order.shape), 1)
    found = np.take_along_axis(place, cell[near], 1)
    held = np.cumsum(np.bincount(found.ravel(), minlength=len(reach))) / found.size
    return int(np.searchsorted(held, REACHED)) + 1


def search_block(
    quantiser: Quantiser,
    ids: np.ndarray,
    codes: np.ndarray,
    vectors: np.ndarray,
    query_ids: np.ndarray,
    queries: np.ndarray,
    k: int,
    kept: int | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, exact scores) of each query's k best found in a block of one cell, whose ids ascend; kept None: of all."""
    own = vectors.astype(np.float64)
    columns = np.ascontiguousarray(codes.T)
    chunk = max(1, 4_000_000 // max(1, len(own)))
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(queries), chunk):
        some, q = query_ids[at : at + chunk], queries[at : at + chunk].astype(np.float64)
        near = np.broadcast_to(np.arange(len(own)), (len(q), len(own)))
        if kept is not None and max(kept, k) < len(own):
            # the centre's score and the spread are the same for all of a cell
            tables = np.stack([quantiser.tables(one) for one in q])
            scores = tables[:, 0].take(columns[0], axis=1)
            for j in range(1, len(columns)):
                scores += tables[:, j].take(columns[j], axis=1)
            near = np.sort(np.argpartition(-scores, max(kept, k) - 1, axis=1)[:, : max(kept, k)], axis=1)
        exact = np.empty(near.shape)
        step = max(1, 1_000_000 // max(1, near.shape[1] * own.shape[1]))
        for low in range(0, len(q), step):
            exact[low : low + step] = (own[near[low : low + step]] * q[low : low + step, None]).sum(2)
        first = np.lexsort((ids[near], -exact))[:, :k]
        out[0].append(np.repeat(some, first.shape[1]))
        out[1].append(np.take_along_axis(ids[near], first, 1).ravel())
        out[2].append(np.take_along_axis(exact, first, 1).ravel())
    return tuple(np.concatenate(c) for c in out)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, str]:
    """((vec_id, v) that take part, once an id; their length; numpy type of a component)."""
    kind = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    v = F.col("v")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    once = own.where(F.size("v") == d).groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("s"))
    return once.select("vec_id", F.col("s.v").alias("v")), d, kind


def nearest(
    rows: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    work: Workspace | None = None,
    probes: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``.

    ``probes``: cells a query is searched in, if not as many as the sample tells.
    """
    spark = rows.sparkSession
    work = work or Workspace(spark, "nearest")
    bounded_batches(spark)
    own, d, kind = usable(rows, id_col, vector_col)
    same = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]  # 128 bits tell vectors apart
    vectors = work.save(own.select("vec_id", "v", *same), "vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copy = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    candidates = vectors.withColumn("copy", copy).where(F.col("copy") <= k + 1)
    asked = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "h", "g")
    one = asked.groupBy("h", "g").agg(F.min("vec_id").alias("first"))
    members = work.save(asked.join(one, ["h", "g"]).select(F.col("vec_id").alias("query_id"), "first"), "members")
    queries = work.save(vectors.join(one.select(F.col("first").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "v"), "queries")
    # at most SAMPLE distinct vectors
    sample = vectors.groupBy("h", "g").agg(F.min(F.struct("vec_id", "v")).alias("s")).select("h", "s.*")
    sample = sample.orderBy("h", "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    cells = max(1, min(MOST_CELLS, round(math.sqrt(n) / 2)))
    sample = sample.combine_chunks().flatten().to_numpy().reshape(-1, d)
    quantiser = fit(sample, cells)
    shared = spark.sparkContext.broadcast(quantiser)  # at most MOST_CELLS vectors, and 32 numbers a subspace

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy().reshape(-1, d).astype(kind)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = of_batch(batch)
            cell = shared.value.cells(x)
            codes = packed(shared.value.encode(x, cell))
            columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vec_id"), *columns], names=["cell", "vec_id", "codes", "v"])

    indexed = work.save(candidates.select("vec_id", "v").mapInArrow(index, "cell int, vec_id long, codes binary, v binary"), "index")
    sizes = np.zeros(len(quantiser.centres), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most MOST_CELLS rows
        sizes[r["cell"]] = r["count"]
    reach = np.where(sizes > 0, quantiser.spread * np.sqrt(2 * np.log(sizes + 1.0)), -np.inf)
    if probes is None:
        # of k nearest of all, so many are in the sample
        probes = cells_needed(quantiser, sample, max(1, round(k * min(1.0, len(sample) / n))), reach)
    many = len(sizes) if exact else min(probes, len(sizes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = of_batch(batch)
            found = shared.value.probed(x, reach, many)
            row = np.repeat(np.arange(len(x)), found.shape[1])
            bytes_ = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel().astype(np.int32)), batch.column("vec_id").take(pa.array(row)), bytes_], names=["cell", "vec_id", "v"]
            )

    probing = queries.mapInArrow(probe, "cell int, vec_id long, v binary")
    loads = np.zeros(len(sizes), np.int64)
    for r in probing.groupBy("cell").count().collect():
        loads[r["cell"]] = r["count"]

    def pieces(of: np.ndarray, size: int):
        return F.get(F.lit(np.maximum(1, -(-of // size)).astype(np.int32)), F.col("cell"))

    blocks, parts = pieces(sizes, ROWS), pieces(loads, QUERIES)
    data = indexed.where(F.get(F.lit(loads > 0), F.col("cell"))).withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asking = probing.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), parts).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def column(table: pa.Table, name: str, type_: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), type_).reshape(table.num_rows, -1)

    kept = None if exact else KEPT

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        found: tuple = ([], [], [])
        if data.num_rows and asked.num_rows:
            ids = data.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            found = search_block(
                shared.value,
                ids[order],
                column(data, "codes", "u1")[order],
                column(data, "v", kind)[order],
                asked.column("vec_id").to_numpy(),
                column(asked, "v", kind),
                k + 1,
                kept,
            )
        return pa.table({"first": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["cell", "block", "part"]
    near = data.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "first long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("score"), "vec_id"))
    lists = (
        near.withColumn("rank", rank)
        .where(F.col("rank") <= k + 1)
        .groupBy("first")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))  # k + 1 of them
    )
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return members.join(lists, "first").select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score"
    )
