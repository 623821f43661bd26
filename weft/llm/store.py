"""Content-addressed store of token-id streams.

A document is its token ids and an end id. A rolling hash over the last
``SPAN`` ids cuts the stream where its top bits are zero, so equal passages
are cut alike wherever they stand; equal chunks are stored once, under the
SHA-256 of their bytes.

Format, a folder of Parquet tables:

- ``chunks``: digest (32 bytes), ids (little-endian unsigned integers of two
  bytes, or four where the vocabulary needs them); one row a digest.
- ``recipes``: the id, part (range of the id order), place (in the part),
  before (ids of the part's earlier documents), n_tokens, digests and ends
  (ids up to the end of each chunk), root (SHA-256 of the id, the ends and the
  Merkle root of the digests). Files and rows ascend by id; null ids come
  first, equal ids stand in order of their root. Rows of one id are split
  between parts like any others.
- ``manifest``: part, start (ids of all parts before), documents, n_tokens,
  root: the Merkle root over the part's document roots, by levels of ``FAN``.
- ``head``: one row with the documents, n_tokens and root of the whole store
  (over the parts' roots), the width of an id in bytes and the end id.

Reading back verifies everything against everything: chunks against their
digests and lengths, recipes against their roots, the recipes' roots, places,
lengths and running starts against the manifest, the manifest against the
head; a chunk that is missing, a recipe or file that is lost and a field that
was altered all raise. ``summary`` puts the CRC-32 of a document together
from those of its verified chunks; ``read`` returns the ids themselves.

Edge cases: null text counts as empty (the end id alone); repeated rows and
null ids are stored and returned like any other; an empty table gives empty
tables; only the id and text columns are read. Memory is proportional to a
batch of texts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import tokens
from weft.llm.common import Workspace, bounded_batches

SPAN = 8
#: A place is a cut with probability 2^-CUT_BITS; chunks have at least LEAST and at most MOST ids.
CUT_BITS, LEAST, MOST = 9, 64, 8192
FAN = 1024
#: Recipes of a part, and of the smaller parts that a store has until every core has one.
PART_ROWS, LEAST_PART_ROWS = 100_000, 2_000
#: Cuts of text that a worker remembers here, and bytes of texts whose cuts it looks up together.
CUTS_KEPT, GROUP_BYTES = 800_000, 6_000_000
#: Digests a task remembers, to write a chunk once.
SEEN = 200_000
#: Places of chunks that other tasks wrote before, up to which they are broadcast (8 bytes each).
BROADCAST = 1_000_000


def cuts(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash cuts (uint32 ids); the first SPAN - 1 are not to be used."""
    h = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    power, n = np.uint32(0x85EBCA6B), 1
    with np.errstate(over="ignore"):
        while n < SPAN:
            h[n:] += h[:-n].copy() * power
            power, n = power * power, n * 2
        return np.flatnonzero((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CUT_BITS) == 0) + 1


def ends_of(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids from the ascending candidate places."""
    ends, last = [], 0
    for p in [*places, n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p == n or p - last >= LEAST:
            if p > last:
                ends.append(p)
            last = p
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is."""
    level = digests
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def root_of(doc_id, ends: list[int], digests: list[bytes]) -> bytes:
    """What a recipe is verified by."""
    return hashlib.sha256(repr(doc_id).encode("utf-8", "surrogatepass") + np.asarray(ends, "<i8").tobytes() + merkle(digests)).digest()


def id_type(path: str, end_id: int) -> str:
    """numpy type of a stored id."""
    return "<u2" if tokens.ids(path, CUTS_KEPT).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"


def chunked(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each row's recipe with the bytes of those chunks that its task has not written yet."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = tokens.ids(path, CUTS_KEPT), id_type(path, end_id)
        end, width, seen = end_id.to_bytes(4, "little"), int(kind[-1]), set()
        place = TaskContext.get().partitionId() << 32
        sha = hashlib.sha256
        for batch in tokens.grouped(batches, GROUP_BYTES):
            streams = encoder.encode(batch.column(1).fill_null(""))
            sizes = [(len(s) >> 2) + 1 for s in streams]
            joined = np.frombuffer(end.join([*streams, b""]), "<u4")
            found = cuts(joined)
            raw = memoryview(joined.astype(kind).tobytes())
            at, bounds = 0, np.searchsorted(found, np.cumsum([0, *sizes]), "right").tolist()
            ends, digests, parts, places, roots = [], [], [], [], []
            for i, (n, doc_id) in enumerate(zip(sizes, batch.column(0).to_pylist(), strict=True)):
                own = ends_of(n, (found[bounds[i] : bounds[i + 1]] - at).tolist())
                names, data, own_places, last = [], [], [], 0
                for e in own:
                    chunk = raw[(at + last) * width : (at + e) * width]
                    digest = sha(chunk).digest()
                    names.append(digest)
                    if digest in seen:
                        data.append(None)
                        own_places.append(None)
                    else:
                        seen.add(digest)
                        data.append(chunk.tobytes())
                        own_places.append(place)
                        place += 1
                    last = e
                at += n
                ends.append(own)
                digests.append(names)
                parts.append(data)
                places.append(own_places)
                roots.append(root_of(doc_id, own, names))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(ends, pa.list_(pa.int64())),
                    pa.array(digests, pa.list_(pa.binary())),
                    pa.array(parts, pa.list_(pa.binary())),
                    pa.array(places, pa.list_(pa.int64())),
                    pa.array(roots, pa.binary()),
                ],
                names=["id", "n_tokens", "ends", "digests", "data", "places", "root"],
            )

    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(
        run,
        f"id {kind}, n_tokens long, ends array<long>, digests array<binary>, data array<binary>, places array<long>, root binary",
    )


def write(docs: DataFrame, path: str, end_id: int, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the store of ``docs`` in the workspace; returns its folder."""
    rows = work.save(chunked(docs, path, end_id, id_col, text_col), "rows", "lz4")
    def written(*columns: tuple[str, str]) -> DataFrame:
        zipped = F.arrays_zip(*[F.col(c).alias(name) for c, name in columns])
        return rows.select(F.explode(zipped).alias("c")).where("c.place is not null").select("c.*")

    found = written(("digests", "digest"), ("places", "place"))
    # which of the chunks that several tasks wrote to leave out: only digests and places are shuffled, never ids
    first = found.groupBy("digest").agg(F.min("place").alias("keep"), F.count("*").alias("n")).where("n > 1")
    again = work.save(found.join(first, "digest").where("place <> keep").select("place"), "again")
    again = F.broadcast(again) if again.count() <= BROADCAST else again
    whole = written(("digests", "digest"), ("data", "ids"), ("places", "place"))
    work.save(whole.join(again, "place", "left_anti").select("digest", "ids"), "store/chunks", "lz4")
    n = rows.count()
    parts = max(math.ceil(n / PART_ROWS), min(math.ceil(n / LEAST_PART_ROWS), docs.sparkSession.sparkContext.defaultParallelism), 1)
    order = [F.col("id").asc_nulls_first(), F.col("root"), F.col("row")]
    ranged = rows.drop("data", "places").withColumn("row", F.monotonically_increasing_id())  # splits rows that are equal in all else
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "n_tokens", "ends", "digests", "root", "part", "place", "before"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            starts = before + np.cumsum(sizes) - sizes
            more = [np.full(len(sizes), part), np.arange(place, place + len(sizes)), starts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in more)], names=names)
            place, before = place + len(sizes), before + int(sizes.sum())

    schema = f"`{id_col}` {kind}, n_tokens long, ends array<long>, digests array<binary>, root binary, part long, place long, before long"
    recipes = work.save(ranged.mapInArrow(numbered, schema), "store/recipes")
    work.drop("rows")
    manifest = work.save(_parts(recipes, work), "store/manifest")
    head = _whole(manifest, work).select(
        "documents", "n_tokens", "root", F.lit(int(id_type(path, end_id)[-1])).alias("width"), F.lit(end_id).cast("long").alias("end_id")
    )
    work.save(head, "store/head")
    return work.path("store")


def _levels(nodes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """One row (part, documents, n_tokens, root) of each part, from its nodes (part, place, before, documents, n_tokens, root).

    Each level joins at most ``FAN`` neighbours, and is null in ``root`` where
    a place is missing or a node does not begin where the one before ends.
    """
    children = F.col("children")
    follows = F.forall(
        F.sequence(F.lit(1), F.size(children) - 1),
        lambda i: (F.get(children, i)["place"] == F.get(children, i - 1)["place"] + 1)
        & (F.get(children, i)["before"] == F.get(children, i - 1)["before"] + F.get(children, i - 1)["n_tokens"]),
    )
    whole = (F.get(children, F.lit(0))["place"] % FAN == 0) & F.when(F.size(children) > 1, follows).otherwise(F.lit(True))
    joined = F.unhex(F.concat_ws("", F.transform(children, lambda x: F.coalesce(F.hex(x["root"]), F.lit("-")))))
    level = nodes
    for number in range(64):
        level = work.save(
            level.groupBy("part", F.expr(f"place div {FAN}").alias("place"))
            .agg(
                F.array_sort(F.collect_list(F.struct("place", "before", "n_tokens", "documents", "root"))).alias("children")  # at most FAN
            )
            .select(
                "part",
                "place",
                F.get(children, F.lit(0))["before"].alias("before"),
                F.aggregate(children, F.lit(0).cast("long"), lambda a, x: a + x["documents"]).alias("documents"),
                F.aggregate(children, F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_tokens"),
                F.when(whole & joined.isNotNull(), F.unhex(F.sha2(joined, 256))).alias("root"),
            ),
            f"{name}{number}",
        )
        if number:
            work.drop(f"{name}{number - 1}")
        if level.agg(F.max("place")).first()[0] in (None, 0):
            return level.select("part", "documents", "n_tokens", F.when(F.col("before") == 0, F.col("root")).alias("root"))
    raise ValueError("the store has more documents than places")


def _parts(recipes: DataFrame, work: Workspace) -> DataFrame:
    """The manifest of recipes; its rows are as many as parts, so their running starts are one window."""
    thin = recipes.select("part", "place", "before", F.lit(1).cast("long").alias("documents"), "n_tokens", "root")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")
    return _levels(thin, work, "nodes").select("part", start.alias("start"), "documents", "n_tokens", "root")


def _whole(manifest: DataFrame, work: Workspace) -> DataFrame:
    """(documents, n_tokens, root) of a store."""
    place = F.row_number().over(Window.orderBy("part")) - 1  # as many rows as parts; a part without rows has none
    nodes = manifest.select(
        F.lit(0).alias("part"), place.cast("long").alias("place"), F.col("start").alias("before"), "documents", "n_tokens", "root"
    )
    found = _levels(nodes, work, "tops")
    none = F.struct(F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("root"))
    return found.agg(F.coalesce(F.max(F.struct("documents", "n_tokens", F.coalesce("root", F.lit(b"broken")).alias("root"))), none).alias("w")).select("w.*")


def verified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """(recipes, manifest, width) of a store whose tables belong together; raises ValueError if they do not."""
    recipes, manifest, head = (spark.read.parquet(f"{folder}/{t}") for t in ("recipes", "manifest", "head"))
    work = Workspace(spark, "verify")
    own = _parts(recipes, work)
    same = [own[c].eqNullSafe(manifest[c]) for c in ("start", "documents", "n_tokens", "root")]
    wrong = own.join(manifest, "part", "full").where(~(same[0] & same[1] & same[2] & same[3]) | own["root"].isNull()).count()
    if wrong:
        raise ValueError(f"{wrong} parts of the recipes do not match the manifest")
    found, want = _whole(manifest, work).first(), head.collect()
    if len(want) != 1 or any(found[c] != want[0][c] for c in ("documents", "n_tokens", "root")):
        raise ValueError("the manifest does not match the head")
    work.drop()
    return recipes, manifest, want[0]["width"]


@cache
def _zeros() -> list[np.ndarray]:
    """For each k, tables that carry a CRC-32 over 2^k zero bytes: four of 256 entries."""

    def times(matrix: list[int], vector: int) -> int:
        total = i = 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector >>= 1
            i += 1
        return total

    one = [0xEDB88320] + [1 << i for i in range(31)]  # a zero bit
    for _ in range(3):
        one = [times(one, x) for x in one]
    tables = []
    for _ in range(44):
        tables.append(np.array([[times(one, b << 8 * k) for b in range(256)] for k in range(4)], np.uint32))
        one = [times(one, x) for x in one]
    return tables


def carried(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values carried over so many following bytes, for XOR with what those add."""
    crc = crc.astype(np.uint32)
    for k, table in enumerate(_zeros()):
        on = np.flatnonzero(zeros >> k & 1)
        if len(on):
            v = crc[on]
            crc[on] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
        if not (zeros >> (k + 1)).any():
            break
    return crc


def _checked(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(digest, n, crc) of every chunk as unsigned 32-bit ids; raises where the bytes do not match the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            data = memoryview(flat.buffers()[2])[ends[0] : ends[-1]]
            wide = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            sizes = np.diff(ends) // width
            ends, more, crc, at = (ends - ends[0]).tolist(), 4 // width, [], 0
            for digest, end in zip(batch.column(0).to_pylist(), ends[1:], strict=True):
                if hashlib.sha256(data[at:end]).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crc.append(zlib.crc32(wide[at * more : end * more]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "ids")
    return chunks.mapInArrow(run, "digest binary, n long, crc long")


def _uses(recipes: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """(id, start, n_tokens, digest, end, size) of every chunk of every document; raises where a recipe does not match its root."""
    own = recipes.select(id_col, "part", "before", "n_tokens", "ends", "digests", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (0, 3, 4, 5, 6))
            for doc_id, n, ends, digests, want in zip(*columns, strict=True):
                if len(ends) != len(digests) or not ends or ends[-1] != n or root_of(doc_id, ends, digests) != want:
                    raise ValueError(f"recipe of {doc_id!r} is damaged")
            yield batch

    starts = F.broadcast(manifest.select("part", F.col("start").alias("part_start")))  # as many rows as parts
    size = F.col("c.end") - F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))
    return (
        own.mapInArrow(run, own.schema)
        .join(starts, "part")
        .select(
            id_col,
            (F.col("part_start") + F.col("before")).alias("start"),
            "n_tokens",
            "ends",
            F.posexplode(F.arrays_zip(F.col("digests").alias("digest"), F.col("ends").alias("end"))).alias("at", "c"),
        )
        .select(id_col, "start", "n_tokens", "c.digest", "c.end", size.alias("size"))
    )


def _or_raise(value: str, n: Column) -> Column:
    """The column of a chunk that was joined, or an error."""
    fails = F.raise_error(F.concat(F.lit("chunk "), F.hex("digest"), F.lit(" is missing or has another length")))
    return F.when(F.col(value).isNotNull() & (n == F.col("size")), F.col(value)).otherwise(fails)


def summary(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    recipes, manifest, width = verified(spark, folder)
    uses = _uses(recipes, manifest, id_col).withColumn("zeros", (F.col("n_tokens") - F.col("end")) * 4)
    joined = uses.join(_checked(spark, folder, width), "digest", "left").select(
        id_col, "start", "n_tokens", "zeros", _or_raise("crc", F.col("n")).alias("crc")
    )
    names = joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = carried(batch.column(4).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part.astype(np.int64))], names=[*names[:3], "part"])

    kind = joined.schema[0].dataType.simpleString()
    parts = joined.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, part long")
    # a document has at least its end id, so its start is its own
    return parts.groupBy("start").agg(
        F.first(id_col).alias(id_col), F.first("n_tokens").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32")
    ).select(id_col, "start", "n_tokens", "ids_crc32")


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids array<long>) of every document, put together from its chunks."""
    recipes, manifest, width = verified(spark, folder)
    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "ids")
    whole = (
        _uses(recipes, manifest, id_col)
        .join(chunks, "digest", "left")
        .withColumn("ids", _or_raise("ids", F.expr(f"octet_length(ids) div {width}")))
        .groupBy("start")
        .agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.struct("end", "digest", "ids"))).alias("c"))
        .select(id_col, "start", F.col("c.digest").alias("digests"), F.col("c.ids").alias("parts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digests, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for d, p in zip(digests, parts, strict=True):
                    if hashlib.sha256(p).digest() != d:
                        raise ValueError(f"chunk {d.hex()} is damaged")
                out.append(np.frombuffer(b"".join(parts), f"<u{width}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], names=[id_col, "start", "ids"])

    kind = whole.schema[0].dataType.simpleString()
    return whole.mapInArrow(run, f"`{id_col}` {kind}, start long, ids array<long>")
