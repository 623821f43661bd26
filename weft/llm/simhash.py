"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A document's fingerprint has a bit set where over half of its shingle
hashes have it set. Documents whose fingerprints differ in at most two bits
are linked, and a group is a connected component of those links.

Every pair within the radius is found, with certainty: bit ``i`` gets a
non-zero vector m(i) of GF(2)^(r+1); for each of the 2^(r+1)-1 non-zero v
there is a table keyed by the fingerprint bits with <m(i), v> = 1. The m(i)
of at most r differing bits span at most r dimensions, so some v is
orthogonal to all of them and that table's key is equal on both sides.

Within a bucket no pairs are enumerated. Two values at distance two or less
have a common value at distance one or less from both, which differs from
them only in bits outside the colliding key. Each fingerprint that shares a
bucket emits those neighbours (at most 65), and everything that meets in one
neighbour is within two bits of everything else there: at most 65 values,
which are linked as a star. So a bucket of k values costs at most 65 k rows.

Edge cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; a null id takes part but never names a group
unless the whole group has none; repeated rows are kept, one result each;
an empty table gives an empty result. Columns other than id and text are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Workspace, bounded_batches, connected_components

BITS = 64
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 17

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The covering family's masks, as unsigned integers."""
    vectors, half = (1 << (radius + 1)) - 1, 1 << radius
    # with fewer bits than vectors those with the first coordinate set: no v but that one is orthogonal to over half of them,
    # so no mask is of a few bits, which would put large shares of all values in one bucket
    own = [1 + i % vectors if bits >= vectors else half + i % half for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``words``-word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles: Iterator[bytes] | list[bytes] = [b" ".join(tokens)]
        n = 1
    else:
        n = len(tokens) - words + 1
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    hashes = (digest(s, SEED) for s in shingles)
    for at in range(0, n, BLOCK):
        h = np.fromiter(hashes, np.uint64, min(BLOCK, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def word_fingerprint(tokens: list[bytes], most: int = 4) -> int:
    """Unsigned 64-bit SimHash of single words, each counted at most ``most`` times: few bits change with a few words."""
    if not tokens:
        return 0
    counts = Counter(tokens)
    weights = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), most)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += weights[at : at + BLOCK] @ bits.astype(np.int64)
    return int(np.packbits(total * 2 > weights.sum(), bitorder="little").view("<u8")[0])


def covered(fp: Column, radius: int) -> Column:
    """array<bigint>: a key of each covering table; values within ``radius`` bits have at least one in common."""
    return F.array(*keys(fp, radius))


def keys(fp: Column, radius: int) -> list[Column]:
    """The key of each covering table."""
    return [F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(as_signed(m)))) for k, m in enumerate(masks(BITS, radius))]


def as_signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): the signed 64-bit view of each row's fingerprint."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def links(values: DataFrame) -> DataFrame:
    """Star edges (u, v) joining all distinct values ``fp`` within two bits of each other."""
    signed = [as_signed(m) for m in masks()]
    keys = values.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
        ).alias("t"),
    ).select("fp", "t.k", "t.key")
    shared = keys.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "key")
    free = F.element_at(F.array(*[F.lit(~m) for m in signed]), F.col("k") + 1)
    near = keys.join(shared, ["k", "key"]).groupBy("fp").agg(F.bit_or(free).alias("free"))
    flips = F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(BITS)])
    neighbours = F.concat(
        F.array("fp"),
        F.transform(F.filter(flips, lambda b: b.bitwiseAND(F.col("free")) != 0), lambda b: F.col("fp").bitwiseXOR(b)),
    )
    met = (
        near.select("fp", F.explode(neighbours).alias("point"))
        .groupBy("point")
        .agg(F.collect_set("fp").alias("all"))  # at most 65 values lie within one bit of a point
        .where(F.size("all") > 1)
    )
    return met.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").distinct()


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, work: Workspace | None = None
) -> tuple[DataFrame, DataFrame]:
    """((id_col, fp) of every row, (fp, root, component_id) of every distinct fingerprint)."""
    work = work or Workspace(docs.sparkSession, "simhash")
    fps = work.save(fingerprints(docs, id_col, text_col, words), "fps")
    values = work.save(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "values")
    roots = work.save(connected_components(links(values.select("fp")), work), "roots")
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps, rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, work: Workspace | None = None
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id in its group)."""
    fps, found = groups(docs, id_col, text_col, words, work)
    return fps.join(found.drop("root"), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
