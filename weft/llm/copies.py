"""Near-copy groups: operator 10 at a wider radius, then five-word shingle sets of a Jaccard similarity of 0.8 or more.

Rows with equal shingle sets are one node. A node's SimHash is that of its
words, each counted at most four times, so that the few words in which near
copies differ turn few of the 64 bits. Nodes meet in the tables of the
covering family of operator 10 for ``RADIUS`` bits: every pair within the
radius shares a key, with certainty. What meets and is within the radius is
compared exactly, on the whole sets, so nothing below 0.8 is linked. A group
is a connected component of the links.

Pairs of a bucket are not enumerated: a join keeps a pair only if its nodes are
in different components yet, it is in the first table where the two meet, and
their parity sketches allow the similarity. A sketch has a bit for each
remainder of a hash, turned by every shingle with that remainder, so two
sketches differ in at most as many bits as the sets differ in shingles, which
at a similarity of 0.8 is a ninth of both sizes. No pair that is alike goes by
that, and few others pass. Shingle sets and sketches are made for nodes that
have another within the radius, once for equal sets.

Rounds let a large group of near copies become one component by few pairs: the
first ones compare the nodes of a bucket with its node of the smallest
component and keep one pair a node, then come the nodes of a growing ``SHARES``
of all, in the end every node. So no pair of a bucket is left out but those
whose nodes are in one component by then, which change nothing.

Edge cases: null text counts as empty, texts without words are copies of each
other, a text of up to five words has one shingle; a group without ids keeps
one row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import simhash
from weft.llm.common import Workspace, batches_of, bounded_batches, connected_components, forget, trim

WORDS = 5
LEAST = 0.8
#: Bits in which the SimHash values of near copies may differ.
RADIUS = 6
SEED = 42
#: Rounds of one pivot a bucket.
FIRST = 2
#: Shares of the nodes that are pivots, in 1/256, of the rounds after those; the last one holds all.
SHARES = (16, 256)
#: Pairs of whole sets in one Arrow batch.
PAIR_ROWS = 50
#: Most bits of a sketch; it has twice as many as its set has shingles, to the next power of two.
SKETCH_BITS = 1 << 16
#: Keys that a task makes.
TASK_KEYS = 1_000_000
#: Nodes up to which the ids of their first rows are broadcast.
BROADCAST = 200_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return shingles_of(words(text))


def shingles_of(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= WORDS:
        return np.array([digest(b" ".join(tokens), SEED)] if tokens else [], np.uint64)
    joined = map(b" ".join, zip(*(tokens[i:] for i in range(WORDS)), strict=False))
    return np.unique(np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(tokens) - WORDS + 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the numbers of a set's hashes with each remainder by the sketch's bits, as 64-bit words."""
    bits = min(SKETCH_BITS, max(64, 2 << (len(own) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text); ``th`` is the hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _node(own: np.ndarray) -> int:
    """The number of a shingle set, as a signed integer."""
    number = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return number - (1 << 64) if number >> 63 else number


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, node, n, fp) of every row: the hash of its text, the number and the size of its shingle set, its SimHash."""
    bounded_batches(docs.sparkSession)
    rows = _texts(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes, sizes, fps = [], [], np.empty(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column(2)):
                tokens = words(t.as_py())
                fps[i] = simhash.word_fingerprint(tokens)
                own = shingles_of(tokens)
                nodes.append(_node(own))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps.view(np.int64))],
                names=["id", "th", "node", "n", "fp"],
            )
            trim()

    return rows.mapInArrow(run, f"id {kind}, th bigint, node bigint, n int, fp bigint")


def sets(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, sketch, own) of the rows that ``firsts`` (f.id, f.th) name; ``own`` is the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(0)]
            sketches = [sketch(own) for own in found]
            ends = np.cumsum([0, *map(len, sketches)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_node(own) for own in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sketches]))),
                    pa.array([own.tobytes() for own in found], pa.binary()),
                ],
                names=["node", "sketch", "own"],
            )
            trim()

    asked = firsts.select(F.col("f.id").alias("__id"), F.col("f.th").alias("__th"))
    if asked.count() <= BROADCAST:
        asked = F.broadcast(asked)
    rows = _texts(docs, id_col, text_col).join(asked, (F.col("th") == F.col("__th")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    # rows repeated in id and text are one
    return rows.dropDuplicates(["id", "th"]).select("text").mapInArrow(run, "node bigint, sketch array<bigint>, own binary")


def _joined(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(u, v, and each column of u's and of v's row, as x_u and x_v)."""
    u, v = (rows.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]) for c in "uv")
    return pairs.select("u", "v").join(u, "u").join(v, "v")


def _allowed(a: Column, b: Column, sizes: Column) -> Column:
    """Whether two sketches differ in no more bits than sets LEAST similar, of ``sizes`` together, differ in shingles."""

    def halved(words: Column) -> Column:
        half = (F.size(words) / 2).cast("int")
        return F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    # sizes of alike sets differ by a quarter at most, so one sketch is at most twice as long
    a, b = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a), F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # numbers of bits are whole, so half a bit more lets the rounded product through
    return apart <= (1 - LEAST) / (1 + LEAST) * sizes + 0.5


def perhaps_alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) without those whose sketches differ in more bits than sets LEAST similar differ in shingles."""
    joined = _joined(pairs, rows, ["n", "sketch"])
    return joined.where(_allowed(F.col("sketch_u"), F.col("sketch_v"), F.col("n_u") + F.col("n_v"))).select("u", "v")


def alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are at least LEAST similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [
                jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= LEAST
                for x, y in zip(a, b, strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return _joined(pairs, rows, ["own"]).select("u", "v", "own_u", "own_v").mapInArrow(run, "u bigint, v bigint")


def _first_key(fp: Column, apart: Column) -> Column:
    """The key of ``fp`` in the first covering table that has none of the bits ``apart``; null if all have."""
    ways = zip(simhash.masks(simhash.BITS, RADIUS), simhash.keys(fp, RADIUS), strict=True)
    (mask, key), *others = ways
    first = F.when(apart.bitwiseAND(F.lit(simhash.as_signed(mask))) == 0, key)
    for mask, key in others:
        first = first.when(apart.bitwiseAND(F.lit(simhash.as_signed(mask))) == 0, key)
    return first


def _close(other: str) -> Column:
    """Whether a row's node and that of ``other`` columns may be alike by their sizes and are within the radius."""
    n = F.col(f"{other}n")
    return (F.least("n", n) >= LEAST * F.greatest("n", n)) & (F.bit_count(F.col("fp").bitwiseXOR(F.col(f"{other}fp"))) <= RADIUS)


def _named(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(prefix + c) for c in columns])


def components(docs: DataFrame, nodes: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of the nodes that are linked to others; ``nodes``: (node, n, fp, f), ``f`` the first row."""
    spark = docs.sparkSession
    every = nodes.where("n > 0")
    # the table is small, its keys are not: tasks by the number of keys
    tasks = max(1, -(-every.count() * len(simhash.masks(simhash.BITS, RADIUS)) // TASK_KEYS))
    met = every.select("node", "fp").repartition(tasks).select("node", F.explode(simhash.covered(F.col("fp"), RADIUS)).alias("key"))
    shared = met.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    found = work.save(met.join(shared.select("key"), "key", "left_semi").join(every.select("node", "n", "fp"), "node"), "met")
    # rows of a bucket with another one within the radius
    others = _named(found, "p", ["node", "n", "fp"]).withColumnRenamed("key", "pkey")
    live = found.join(others, (F.col("key") == F.col("pkey")) & (F.col("node") != F.col("pnode")) & _close("p"), "left_semi")
    live = work.save(live, "live")
    work.drop("met")
    firsts = work.save(nodes.join(live.select("node").distinct(), "node", "left_semi").select("f"), "firsts")
    own = work.save(sets(docs, firsts, id_col, text_col), "sets")
    buckets = work.save(live.join(own.select("node", "sketch"), "node"), "buckets")
    links = spark.createDataFrame([], "u long, v long")
    roots = spark.createDataFrame([], "node long, root long")
    tested = spark.createDataFrame([], "u long, v long")
    columns = ["node", "n", "fp", "root", "sketch"]
    for step, share in enumerate([None] * FIRST + list(SHARES)):
        rows = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ends = rows.groupBy("key").agg(F.min(F.struct("root", "node")).alias("a"), F.max("root").alias("b")).where("a.root <> b").select("key", "a.node")
        if share is None:
            pivots = _named(rows.join(ends, ["key", "node"], "left_semi"), "p", columns)
            wanted = F.lit(True)
        else:
            rows = work.save(rows.join(ends.select("key"), "key", "left_semi"), f"open{step}")
            pivot = lambda node: F.pmod(F.xxhash64(node), F.lit(256)) < share
            pivots = _named(rows.where(pivot("node")), "p", columns)
            # either way round and in one table only
            wanted = ((F.col("node") < F.col("pnode")) | ~pivot("node")) & (
                F.col("key") == _first_key(F.col("fp"), F.col("fp").bitwiseXOR(F.col("pfp")))
            )
        pivots = pivots.withColumnRenamed("key", "pkey")
        allowed = _allowed(F.col("sketch"), F.col("psketch"), F.col("n") + F.col("pn"))
        pairs = rows.join(pivots, (F.col("key") == F.col("pkey")) & (F.col("root") != F.col("proot")) & _close("p") & wanted & allowed)
        if share is None:
            pairs = pairs.groupBy("node").agg(F.min("pnode").alias("pnode"))
        pairs = pairs.select(F.least("node", "pnode").alias("u"), F.greatest("node", "pnode").alias("v")).distinct()
        near = work.save(pairs.join(tested, ["u", "v"], "left_anti"), f"near{step}")
        if near.isEmpty():
            continue
        tested = tested.unionByName(near)
        with batches_of(spark, PAIR_ROWS):
            links = links.unionByName(work.save(alike(near, own), f"links{step}"))
        roots = connected_components(links, work, f"cc{step}_")
    return roots


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near copies, columns unchanged: that of the smallest id, then text hash."""
    work = work or Workspace(docs.sparkSession, "copies")
    rows = work.save(signatures(docs, id_col, text_col), "rows")
    # word counts may differ in case of equal shingle sets, so the smallest value stands for a node
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("f")
    nodes = work.save(rows.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), first), "nodes")
    roots = work.save(components(docs, nodes, work, id_col, text_col), "roots")
    firsts = (
        nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("f").alias("f"))
        .select(F.col("f.id").alias("__id"), F.col("f.th").alias("__th"))
    )
    again = rows.groupBy("id", "th").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    hashed = docs.withColumn("__t", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = (F.col("__t") == F.col("__th")) & F.col(id_col).eqNullSafe(F.col("__id"))
    kept = hashed.join(firsts, same, "left_semi")
    single = kept.join(again, same, "left_anti")
    several = kept.join(again, same, "left_semi").withColumn("__r", F.row_number().over(Window.partitionBy(id_col, "__t").orderBy("__t")))
    return single.unionByName(several.where("__r = 1").drop("__r")).drop("__t")
