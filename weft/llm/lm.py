"""Language-model scores by a hierarchical Pitman-Yor model of words after words.

Three levels of restaurants share parents. A word is served by the restaurant
of the word before it (of the end of a text, before the first); those of all
contexts share one restaurant of words as their parent; and that one orders
new words from byte restaurants that spell them, one for each context of two
bytes, whose parents are those of one byte and the root (base: uniform over
bytes). The end of a text is a word of its own. So every text has a
probability, unseen words too, and the probabilities of all words after a
context add up to one. ``score`` is the log10 of the text's probability.

The restaurant of a context is found by ``CONTEXT_BITS`` bits of the hash of
the word before: the most that is known of all contexts at once, their
numbers of customers and tables, has a fixed size, while the cells (context,
word, customers) grow with the corpus. Rare words may share a restaurant.

Seating is sampled by Gibbs sweeps over the levels: all customers of a dish
leave and come back one after the other, each opening a table with its
conditional probability given the tables of its restaurant and the base of
the last sweep; tables are the customers of the parent. From ``EXACT``
customers on, they come back in groups of ``STEP`` of those seated. Random
numbers are made of the cell and the sweep, so a lost task samples the same
again. Probabilities are averaged over ``SAMPLES`` sweeps after ``BURN``.
Discounts are estimated from the numbers of cells with one and two customers.

Texts are parsed once, in blocks. A block keeps its documents as streams of
its own word numbers, and its cells with the training customers of each. Only
cells are shuffled, packed by ranges of the word hash (shards) and merged by
``FAN`` blocks at a time, so that what a task reads of the most frequent word
is bounded; the cells of a word are together, so that a sweep needs no
shuffle. Prices of cells go back down the same tree to the blocks.

Bounds: a block holds ``BLOCK_BYTES`` of text or ``BLOCK_WORDS`` words (and at
least one batch); the driver gets, and broadcasts, at most 2^CONTEXT_BITS
numbers of a sweep and the cells of the byte restaurants (2^24 at most; 3,000
contexts of 256 in the tests' languages). Two words whose 64-bit hashes are
equal would be one.

Edge cases: null text counts as empty (the end alone); without training
documents the base score is 0 and the model is its spelling base; repeated
rows and null ids are scored like any other; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import Workspace, bounded_batches, fold_of

CONTEXT_BITS = 18
BURN, SAMPLES = 1, 3
EXACT, STEP = 200, 0.02
STRENGTH = 1.0
#: Distinct words and bytes of text after which a block of documents is closed.
BLOCK_WORDS, BLOCK_BYTES = 400_000, 24_000_000
#: Bytes of text for each shard of the words.
SHARD_BYTES = 16_000_000
#: Blocks whose cells are merged at once.
FAN = 64
#: Dishes whose customers are seated at once.
SEATED = 16_384
#: Stands for the end of a text: white space is never part of a word.
END = b"\n"
_SPACE = 0x20
_LOW = (1 << CONTEXT_BITS) - 1


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) made of 64-bit keys and a salt."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial numbers from uniform ones: by the normal curve if wide, else by adding up probabilities."""
    mean = n * p
    wide = mean * (1 - p) > 25
    out = np.zeros(len(n), np.int64)
    if wide.any():
        # logistic approximation of the normal quantile
        z = np.log(u[wide] / (1 - u[wide])) / 1.702
        out[wide] = np.rint(mean[wide] + z * np.sqrt(mean[wide] * (1 - p[wide])))
    small = np.flatnonzero(~wide)
    if len(small):
        m, q, v = n[small], np.minimum(p[small], 1 - 1e-12), u[small]
        term = np.exp(m * np.log1p(-q))
        total, k = term.copy(), np.zeros(len(small), np.int64)
        for i in range(1, 200):
            more = (v > total) & (k == i - 1) & (k < m)
            if not more.any():
                break
            term = term * np.maximum(m - i + 1, 0) / i * q / (1 - q)
            total = total + term
            k[more] = i
        out[small] = k
    return np.clip(out, 0, n)


def seat(c: np.ndarray, pull: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of dishes with ``c`` customers; ``pull``: (strength + discount * tables) * base probability."""
    tables = (c > 0).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    order = order[: np.searchsorted(-c[order], -1, "left")]  # a single customer has one table
    for low in range(0, len(order), SEATED):
        some = order[low : low + SEATED]
        tables[some] = _seated(c[some], pull[some], discount, key[some].astype(np.uint64), salt)
    return tables


def _seated(c: np.ndarray, pull: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """The same of dishes with at least two customers each, most first."""
    own, at, most = np.ones(len(c)), 1, int(c[0])
    while at < most:
        group = max(1, int(at * STEP)) if at >= EXACT else 1
        live = int(np.searchsorted(-c, -at, "left"))
        new = pull[:live] / (pull[:live] + at - discount * own[:live])
        u = uniform(key[:live], salt * 1_000_003 + at)
        if group == 1:
            own[:live] += u < new
        else:
            own[:live] += _binomial(np.minimum(group, c[:live] - at), new, u)
        at += group
    return own.astype(np.int64)


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.05


@dataclass
class Bytes:
    """Probabilities of a byte after two: rows of seen contexts, then of single bytes."""

    row: np.ndarray
    table: np.ndarray
    logs: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.table = self.table.astype(np.float32)  # at most 67 MB, whatever the text
        self.logs = np.log(self.table)

    def words(self, words: pa.Array) -> np.ndarray:
        """Natural log-probability of the spelling of each word (not null)."""
        return self.of_spelled(*spelled(words))

    def of_spelled(self, symbols: np.ndarray, contexts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rows = self.row[contexts]
        rows = np.where(rows >= 0, rows, len(self.table) - 256 + (contexts & 255))
        logs = self.logs[rows, symbols]
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]), dtype=np.float64) if len(ends) else np.zeros(0)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, contexts, ends): each word's bytes and a space; the end of a text has no space."""
    words = words.cast(pa.large_binary())
    kind = pa.large_binary()
    tail = pc.if_else(pc.equal(words, pa.scalar(END, kind)), pa.scalar(b"", kind), pa.scalar(b" ", kind))
    flat = pc.binary_join_element_wise(words, tail, pa.scalar(b"", kind))
    places = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    symbols = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[places[0] : places[-1]].astype(np.int64)
    starts, ends = places[:-1] - places[0], places[1:] - places[0]
    last = np.roll(symbols, 1)
    before = np.roll(symbols, 2)
    last[starts] = _SPACE
    before[starts] = _SPACE
    second = starts[ends - starts > 1] + 1
    before[second] = _SPACE
    return symbols, before << 8 | last, ends


def uniform_bytes() -> Bytes:
    return Bytes(np.full(1 << 16, -1, np.int32), np.full((256, 256), 1 / 256, np.float64))


def byte_model(cells: np.ndarray, counts: np.ndarray, salt: int, sweeps: int = 3) -> Bytes:
    """Seat the customers ``counts`` of the cells (context << 8 | byte, ascending) and read off the probabilities."""
    context, byte = cells >> 8, cells & 255
    last = context & 255
    root = np.full(256, 1 / 256)
    one = np.broadcast_to(root, (256, 256)).copy()
    tables2 = np.ones(len(cells), np.int64)
    tables1 = np.ones(0, np.int64)
    tables0 = np.ones(256, np.int64)

    def served(c, t, size, group, discount):
        """((c - d t) by cell, total customers and the share passed on by group)."""
        total, table = np.bincount(group, c, size), np.bincount(group, t, size)
        return (c - discount * t) / (STRENGTH + total[group]), (STRENGTH + discount * table) / (STRENGTH + total)

    d2 = discount_of((counts == 1).sum(), (counts == 2).sum())
    seen, where = np.unique(context, return_inverse=True)
    for sweep in range(sweeps):
        base = one[last, byte]
        pull = (STRENGTH + d2 * np.bincount(where, tables2, len(seen))[where]) * base
        tables2 = seat(counts, pull, d2, cells, salt * 100 + sweep * 3)
        cells1, at1 = np.unique(last << 8 | byte, return_inverse=True)
        counts1 = np.bincount(at1, tables2).astype(np.int64)
        group1 = cells1 >> 8
        d1 = discount_of((counts1 == 1).sum(), (counts1 == 2).sum())
        if len(tables1) != len(cells1):
            tables1 = np.ones(len(cells1), np.int64)
        pull = (STRENGTH + d1 * np.bincount(group1, tables1, 256)[group1]) * root[cells1 & 255]
        tables1 = seat(counts1, pull, d1, cells1, salt * 100 + sweep * 3 + 1)
        counts0 = np.bincount(cells1 & 255, tables1, 256).astype(np.int64)
        d0 = discount_of((counts0 == 1).sum(), (counts0 == 2).sum())
        tables0 = seat(counts0, np.full(256, (STRENGTH + d0 * tables0.sum()) / 256), d0, np.arange(256), salt * 100 + sweep * 3 + 2)
        own, rest = served(counts0, tables0, 1, np.zeros(256, int), d0)
        root = own + rest[0] / 256
        own, rest = served(counts1, tables1, 256, group1, d1)
        one = rest[:, None] * root[None]
        one[group1, cells1 & 255] += own
    row = np.full(1 << 16, -1, np.int32)
    row[seen] = np.arange(len(seen))
    own, rest = served(counts, tables2, len(seen), where, d2)
    table = np.concatenate([rest[:, None] * one[seen & 255], one])
    table[where, byte] += own
    return Bytes(row, table)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by bytes of equal rank, compressed."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def joined(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join([b"" if w == END else w for w in words]))


def split(data: bytes) -> list[bytes]:
    return [w or END for w in zstandard.ZstdDecompressor().decompress(data).split(b"\n")]


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, counted anew from each start."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ascending numbers of runs of ``sizes`` (none is empty) from their differences."""
    total = np.cumsum(values)
    starts = np.cumsum(sizes) - sizes
    return total - np.repeat(total[starts] - values[starts], sizes)


def cells_of(stream: np.ndarray, rank: np.ndarray, context: np.ndarray) -> np.ndarray:
    """word rank << CONTEXT_BITS | context of each token of texts in a row; an end (word 0) is before the first."""
    before = np.roll(stream, 1)
    if len(before):
        before[0] = 0
    return rank[stream] << CONTEXT_BITS | context[before]


def parsed(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """Documents (kind 0: block, id, held, n_tokens, stream), their blocks' numbering (kind 0: words, contexts), and cells (kind 1)."""
    bounded_batches(docs.sparkSession)
    own = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (fold_of(F.col(id_col), 10) == 0).alias("held")
    )
    kind = own.schema["id"].dataType.simpleString()
    names = ["kind", "block", "id", "held", "n_tokens", "stream", "shard", "words", "sizes", "contexts", "customers"]
    types = [pa.int32(), pa.int64(), None, pa.bool_(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, known, streams, learned, size = TaskContext.get().partitionId(), 0, {END: 0}, [], [], 0
        id_type = pa.int64()

        def rows(n: int, which: int, **given) -> pa.RecordBatch:
            given |= {"kind": pa.array([which] * n, pa.int32()), "block": pa.array([task << 32 | number] * n, pa.int64())}
            columns = [given.get(c, pa.nulls(n, t or id_type)) for c, t in zip(names, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def closed() -> Iterator[pa.RecordBatch]:
            words = list(known)
            keys = hashes(words)
            order = np.argsort(keys, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            context = (keys & np.uint64(_LOW)).astype(np.int64)
            yield rows(1, 0, words=pa.array([pack(rank)], pa.binary()), contexts=pa.array([pack(context)], pa.binary()))
            stream = np.concatenate(streams).astype(np.int64)
            # the lowest bit tells training tokens
            cells = np.sort(cells_of(stream, rank, context) << 1 | np.concatenate(learned))
            first = np.flatnonzero(np.diff(cells >> 1, prepend=-1))
            customers = np.add.reduceat(cells & 1, first)
            cells = cells[first] >> 1
            low = np.searchsorted(cells >> CONTEXT_BITS, np.arange(len(words) + 1))  # every word has a cell, but perhaps the end
            shard = ((keys[order] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a == b or low[a] == low[b]:
                    continue
                own_cells, sizes = cells[low[a] : low[b]], np.diff(low[a : b + 1])
                some = [words[i] for i in order[a:b]]
                if not sizes.all():
                    some, sizes = [w for w, n in zip(some, sizes, strict=True) if n], sizes[sizes > 0]
                yield rows(
                    1,
                    1,
                    shard=pa.array([s], pa.int32()),
                    words=pa.array([joined(some)], pa.binary()),
                    sizes=pa.array([pack(sizes)], pa.binary()),
                    contexts=pa.array([pack(steps(own_cells & _LOW, np.cumsum(sizes) - sizes))], pa.binary()),
                    customers=pa.array([pack(customers[low[a] : low[b]])], pa.binary()),
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field(0).type
            texts = pc.ascii_lower(batch.column(1).fill_null(""))
            cut = pc.ascii_split_whitespace(texts)
            found = cut.flatten().cast(pa.binary()).dictionary_encode()
            cuts = found.dictionary.to_pylist()
            place = np.fromiter((known.setdefault(w, len(known)) if w else -1 for w in cuts), np.int64, len(cuts))
            which = place[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
            row, which = row[which >= 0], which[which >= 0]
            n_tokens = np.bincount(row, minlength=len(texts)) + 1
            stream = np.zeros(len(which) + len(texts), np.uint32)
            stream[np.arange(len(which)) + row] = which  # an end, word 0, follows each text
            streams.append(stream)
            learned.append(np.repeat(~batch.column(2).to_numpy(zero_copy_only=False).astype(bool), n_tokens))
            ends = np.cumsum(n_tokens).tolist()
            yield rows(
                len(texts),
                0,
                id=batch.column(0),
                held=batch.column(2),
                n_tokens=pa.array(n_tokens, pa.int64()),
                stream=pa.array([pack(stream[e - n : e]) for e, n in zip(ends, n_tokens.tolist(), strict=True)], pa.binary()),
            )
            size += texts.nbytes
            if len(known) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                yield from closed()
                number, known, streams, learned, size = number + 1, {END: 0}, [], [], 0
        if streams:
            yield from closed()

    schema = (
        f"kind int, block long, id {kind}, held boolean, n_tokens long, stream binary, shard int, words binary, sizes binary, "
        "contexts binary, customers binary"
    )
    return own.mapInArrow(run, schema)


_NODE = "shard int, node long, words binary, sizes binary, contexts binary, customers binary"


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes (shard, node, cells) joined by ``FAN``: their cells, and of each child where its words and cells are among them."""

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by("node").to_pydict()
        words = [split(w) for w in own["words"]]
        flat = [w for some in words for w in some]
        keys, first, which = np.unique(hashes(flat), return_index=True, return_inverse=True)
        each = np.cumsum([0, *(len(w) for w in words)])
        sizes = [unpack(x) for x in own["sizes"]]
        cells = [
            np.repeat(which[each[i] : each[i + 1]], n) << CONTEXT_BITS | summed(unpack(x), n)
            for i, (x, n) in enumerate(zip(own["contexts"], sizes, strict=True))
        ]
        every = np.unique(np.concatenate(cells))
        customers, at_cells = np.zeros(len(every), np.int64), []
        for some, c in zip(cells, own["customers"], strict=True):
            at = np.searchsorted(every, some)
            customers[at] += unpack(c)
            at_cells.append(pack(np.diff(at, prepend=0)))
        counts = np.bincount(every >> CONTEXT_BITS, minlength=len(keys))
        out = {
            "shard": own["shard"][:1],
            "node": [own["node"][0] // FAN],
            "words": [joined([flat[i] for i in first])],
            "sizes": [pack(counts)],
            "contexts": [pack(steps(every & _LOW, np.cumsum(counts) - counts))],
            "customers": [pack(customers)],
            "children": [own["node"]],
            "at_words": [[pack(np.diff(which[a:b], prepend=0)) for a, b in zip(each, each[1:])]],
            "at_cells": [at_cells],
        }
        return pa.table(out, pa.schema(kinds))

    binary, many = pa.binary(), pa.list_(pa.binary())
    kinds = [("shard", pa.int32()), ("node", pa.int64()), ("words", binary), ("sizes", binary), ("contexts", binary), ("customers", binary)]
    kinds += [("children", pa.list_(pa.int64())), ("at_words", many), ("at_cells", many)]
    schema = f"{_NODE}, children array<long>, at_words array<binary>, at_cells array<binary>"
    grouped = nodes.withColumn("parent", F.expr(f"node div {FAN}")).groupBy("shard", "parent")
    return grouped.applyInArrow(run, schema)


@dataclass
class Model:
    """What all shards share: of each sweep the tables of contexts, all tables and customers of words, and the byte model."""

    customers: np.ndarray
    tokens: int
    types: int
    word_discount: float
    context_discount: float
    byte_models: list[Bytes]
    tables: list[np.ndarray]
    word_customers: list[int]
    word_tables: list[int]


@dataclass
class Cells:
    """The cells of a shard and their seating, from sweep to sweep."""

    words: pa.Array
    keys: np.ndarray
    word: np.ndarray
    context: np.ndarray
    c: np.ndarray
    starts: np.ndarray
    spelled: tuple[np.ndarray, np.ndarray, np.ndarray] = None
    _spelling: dict = field(default_factory=dict)

    @classmethod
    def of(cls, words: bytes, sizes: bytes, contexts: bytes, customers: bytes) -> Cells:
        names, n = split(words), unpack(sizes)
        own = pa.array(names, pa.binary())
        return cls(
            own, hashes(names).view(np.int64), np.repeat(np.arange(len(n)), n), summed(unpack(contexts), n), unpack(customers), np.cumsum(n) - n, spelled(own)
        )

    def spelling(self, model: Model, s: int) -> np.ndarray:
        """Probability of each word's spelling under the byte model of a sweep."""
        if s not in self._spelling:
            self._spelling[s] = np.exp(model.byte_models[s].of_spelled(*self.spelled))
        return self._spelling[s]

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def sweeps(self, model: Model, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of cells, customers and tables of words) of the first state, one table a dish, and of each sweep."""
        tables = (self.c > 0).astype(np.int64)
        customers = self.by_word(tables)
        word_tables = (customers > 0).astype(np.int64)
        yield tables, customers, word_tables
        many = np.flatnonzero(self.c > 1)
        with np.errstate(over="ignore"):
            cell_keys = self.keys[self.word[many]] * np.int64(0x9E3779B97F4A7C1) + self.context[many]
        for s in range(1, upto + 1):
            base = self.base(model, s - 1, customers, word_tables)[self.word[many]]
            pull = (STRENGTH + model.context_discount * model.tables[s - 1][self.context[many]]) * base
            tables = (self.c > 0).astype(np.int64)
            tables[many] = seat(self.c[many], pull, model.context_discount, cell_keys, 2 * s)
            customers = self.by_word(tables)
            pull = (STRENGTH + model.word_discount * model.word_tables[s - 1]) * self.spelling(model, s - 1)
            word_tables = seat(customers, pull, model.word_discount, self.keys, 2 * s + 1)
            yield tables, customers, word_tables

    def base(self, model: Model, s: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of each word."""
        rest = (STRENGTH + model.word_discount * model.word_tables[s]) * self.spelling(model, s)
        return (customers - model.word_discount * tables + rest) / (STRENGTH + model.word_customers[s])

    def log10(self, model: Model) -> np.ndarray:
        """log10 of the probability of each cell, averaged over the kept sweeps."""
        total = np.zeros(len(self.c))
        seated = STRENGTH + model.customers[self.context]
        for s, (tables, customers, word_tables) in enumerate(self.sweeps(model, len(model.tables) - 1)):
            if s > BURN or len(model.tables) == 1:
                rest = STRENGTH + model.context_discount * model.tables[s][self.context]
                own = self.c - model.context_discount * tables
                total += (own + rest * self.base(model, s, customers, word_tables)[self.word]) / seated
        return np.log10(np.maximum(total / max(1, len(model.tables) - 1 - BURN), 1e-300))


#: Numbers of the sums that shards send: byte cells are below 2^24, contexts follow.
_TABLES, _CUSTOMERS = 1 << 32, 2 << 32
_SUMS = ["tokens", "types", "ones", "twos", "word_ones", "word_twos", "word_customers", "word_tables"]


def train(top: DataFrame) -> Model:
    """Sample the model of the merged cells: one job a sweep, without a shuffle but for its sums."""
    spark = top.sparkSession
    none = np.zeros(1 << CONTEXT_BITS)
    model = Model(none, 0, 0, 0.5, 0.5, [uniform_bytes()], [none], [0], [0])
    for sweep in range(BURN + SAMPLES + 1):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, sweep=sweep) -> Iterator[pa.RecordBatch]:
            contexts = np.zeros((2, 1 << CONTEXT_BITS), np.int64)
            sums, spelled_cells = np.zeros(len(_SUMS), np.int64), {}
            for batch in batches:
                for row in batch.to_pylist():
                    own = Cells.of(**row)
                    for state in own.sweeps(shared.value, sweep):
                        tables, customers, word_tables = state
                    contexts[0] += np.bincount(own.context, tables, 1 << CONTEXT_BITS).astype(np.int64)
                    sums[6:] += customers.sum(), word_tables.sum()
                    if not sweep:
                        contexts[1] += np.bincount(own.context, own.c, 1 << CONTEXT_BITS).astype(np.int64)
                        sums[:6] += [
                            own.c.sum(), (customers > 0).sum(), (own.c == 1).sum(), (own.c == 2).sum(), (customers == 1).sum(), (customers == 2).sum()
                        ]
                        continue
                    symbols, before, ends = own.spelled
                    each = np.repeat(word_tables, np.diff(ends, prepend=0))
                    found, at = np.unique(before << 8 | symbols, return_inverse=True)
                    for cell, n in zip(found.tolist(), np.bincount(at, each, len(found)).astype(np.int64).tolist(), strict=True):
                        if n:
                            spelled_cells[cell] = spelled_cells.get(cell, 0) + n
            used = [np.flatnonzero(c) for c in contexts]
            cell = np.concatenate([np.array(list(spelled_cells), np.int64), used[0] + _TABLES, used[1] + _CUSTOMERS, -1 - np.arange(len(_SUMS))])
            n = np.concatenate([np.array(list(spelled_cells.values()), np.int64), contexts[0][used[0]], contexts[1][used[1]], sums])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        own = top.select("words", "sizes", "contexts", "customers").mapInArrow(run, "cell long, n long")
        got = own.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # bounded: see the module
        shared.unpersist()
        cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
        sums = dict.fromkeys(_SUMS, 0) | {_SUMS[-1 - i]: int(v) for i, v in zip(cell[cell < 0].tolist(), n[cell < 0].tolist(), strict=True)}

        def by_context(base: int) -> np.ndarray:
            out, on = np.zeros(1 << CONTEXT_BITS), (cell >= base) & (cell < base + (1 << 32))
            out[cell[on] - base] = n[on]
            return out

        if not sweep:
            model = Model(
                by_context(_CUSTOMERS), sums["tokens"], sums["types"], discount_of(sums["word_ones"], sums["word_twos"]),
                discount_of(sums["ones"], sums["twos"]), [uniform_bytes()], [by_context(_TABLES)], [sums["word_customers"]], [sums["word_tables"]],
            )
            if not model.tokens:
                return model
            continue
        on = (cell >= 0) & (cell < _TABLES)
        order = np.argsort(cell[on])
        model.byte_models.append(byte_model(cell[on][order], n[on][order], sweep))
        model.tables.append(by_context(_TABLES))
        model.word_customers.append(sums["word_customers"])
        model.word_tables.append(sums["word_tables"])
    return model


_PRICES = "shard int, node long, counts binary, prices binary"


def _shared_out(row: dict, counts: np.ndarray, prices: np.ndarray) -> Iterator[tuple]:
    """(shard, child, counts of its words, prices of its cells)."""
    for child, words, cells in zip(row["children"], row["at_words"], row["at_cells"], strict=True):
        own = np.cumsum(unpack(words)), np.cumsum(unpack(cells))
        yield row["shard"], child, pack(np.minimum(counts[own[0]], (1 << 32) - 1)), prices[own[1]].astype("<f4").tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "node", "counts", "prices"])


def priced(levels: list[DataFrame], model: Model) -> DataFrame:
    """(shard, node, counts, prices) of every block, from the merged levels, the top one last."""
    shared = levels[-1].sparkSession.sparkContext.broadcast(model)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Cells.of(row["words"], row["sizes"], row["contexts"], row["customers"])
                yield _batch(list(_shared_out(row, own.by_word(own.c), own.log10(shared.value))))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(list(_shared_out(row, unpack(row["counts"]), np.frombuffer(row["prices"], "<f4"))))

    found = levels[-1].mapInArrow(top, _PRICES)
    for level in reversed(levels[:-1]):
        found = found.join(level.select("shard", "node", "children", "at_words", "at_cells"), ["shard", "node"]).mapInArrow(down, _PRICES)
    return found


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    found = parsed(docs, id_col, text_col, max(1, math.ceil((size["bytes"] or 0) / SHARD_BYTES)))
    found.write.mode("overwrite").partitionBy("kind").option("compression", "lz4").parquet(work.path("parsed"))
    rows, cells = (spark.read.schema(found.drop("kind").schema).parquet(work.path(f"parsed/kind={k}")) for k in (0, 1))
    # blocks are numbered without gaps; they are as many as the corpus has times BLOCK_BYTES of text
    blocks = cells.select("block").distinct().select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("long").alias("node"))
    blocks = work.save(blocks, "blocks")
    level = cells.join(F.broadcast(blocks), "block").select("shard", "node", "words", "sizes", "contexts", "customers")
    levels, width = [], blocks.count()
    while not levels or width > 1:
        level = work.save(merged(level), f"level{len(levels)}", "lz4")
        if not levels:
            work.drop("parsed/kind=1")
        levels.append(level)
        width = math.ceil(width / FAN)
    model = train(level)
    prices = priced(levels, model).join(F.broadcast(blocks), "node").select(F.col("block").alias("own"), "shard", "counts", "prices")
    tokens, types = model.tokens, model.types

    def add(bag: pa.Table, prices: pa.Table) -> pa.Table:
        numbering = bag.filter(pc.is_valid(bag.column("words"))).to_pylist()[0]
        bag = bag.filter(pc.is_null(bag.column("words")))
        prices = prices.sort_by("shard")
        rank, context = unpack(numbering["words"]), unpack(numbering["contexts"])
        stream = np.concatenate([unpack(x) for x in bag.column("stream").to_pylist()])
        n_tokens = bag.column("n_tokens").to_numpy()
        cells = cells_of(stream, rank, context)
        every, at = np.unique(cells, return_inverse=True)
        price = np.frombuffer(b"".join(prices.column("prices").to_pylist()), "<f4").astype(np.float64)
        counts = np.concatenate([unpack(x) for x in prices.column("counts").to_pylist()])
        if len(price) != len(every):
            raise ValueError("a block's prices do not fit its cells")
        # words without a cell have no count: only an end that no other word precedes
        own, of_word = np.unique(every >> CONTEXT_BITS, return_inverse=True)
        if len(own) != len(counts):
            raise ValueError("a block's counts do not fit its words")
        count = counts[of_word][at]
        base = np.log10((count + 0.1) / (tokens + 0.1 * (types + 1)))
        starts = np.cumsum(n_tokens) - n_tokens
        return pa.table(
            {
                id_col: bag.column("id"),
                "held_out": bag.column("held"),
                "n_tokens": bag.column("n_tokens"),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                "train_tokens": pa.array([tokens] * bag.num_rows, pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(price[at], starts)),
            }
        )

    bags = rows.select("block", "id", "held", "n_tokens", "stream", "words", "contexts")
    return bags.groupBy("block").cogroup(prices.groupBy("own")).applyInArrow(add, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, tokens, base_perplexity, perplexity) a token, of the rows of ``score``."""
    def of(c: str):
        return F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), of("base_score").alias("base_perplexity"), of("score").alias("perplexity"))
