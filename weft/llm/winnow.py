"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``K`` characters has a rolling (Karp-Rabin) hash over the codes
of its character pairs, modulo a prime; of each ``WINDOW`` neighbouring
hashes the smallest is chosen, the rightmost of equals. So two texts that
share ``K + WINDOW - 1`` characters share a chosen hash, and every choice
keeps its position.

The hash of 2n characters is the hash of the first n times a power plus the
hash of the next n: the rolling hash of all positions is built by doubling,
and the window minimum likewise. A hash and its position travel in one
integer, hash * 2^32 - position, whose minimum is the smallest hash,
rightmost first. Texts are worked off in blocks of ``BLOCK`` windows, so the
working memory does not grow with a text.

Edge cases: a text shorter than ``K`` has one hash of itself at position 0,
shorter than a full window the smallest of what it has; null counts as
empty; the empty text has an empty fingerprint, which is alike (1.0) to
another empty one and to nothing else (0.0); positions are in code points
and must stay below 2^32; repeated rows and null ids are kept, null ids
sort first and equal ids by the hash of their text; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import MOST_RANGES, Ranges, Workspace

K = 8
WINDOW = 16
BLOCK = 8192
PRIME = (1 << 31) - 1
#: A pair's code is below 2^31 in size, so hashes of K characters stay below 2^62 until the prime is taken.
BASE = 1021
#: Rows between two cuts of the id order.
BUCKET_ROWS = 250
#: Rows equal in id and text from which they are worked off as one.
HOT_ROWS = 1000

_HIGH = 1 << 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _from(values: Column, at: int) -> Column:
    """The array without its first ``at`` values."""
    return F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0)))


def _roller(n: int) -> Callable[[Column], Column]:
    """From hashes of n characters to those of 2n; the last n of them are null."""
    power = BASE ** (n // 2)

    def roll(values: Column) -> Column:
        return F.zip_with(values, _from(values, n), lambda a, b: a * F.lit(power) + b)

    return roll


def _minimiser(n: int) -> Callable[[Column], Column]:
    """From minima of n neighbours to those of 2n; at the end of fewer."""

    def least(values: Column) -> Column:
        return F.zip_with(values, _from(values, n), lambda a, b: F.least(a, b))

    return least


def _block(text: Column, first: Column) -> Column:
    """Chosen (packed) hashes of the windows of one block, by position; ``first``: its place in the text."""

    # each step is the body of the one before: what a body returns is copied, and only choices are few
    def of(chars: Column) -> Column:
        return rolled(F.zip_with(chars, _from(chars, 1), lambda a, b: F.hash(a, b).cast("long")), 2, chars)

    def rolled(hashes: Column, n: int, chars: Column) -> Column:
        if n * 2 < K:  # K is a power of two: 4 or 8
            return _let(hashes, lambda v: rolled(_roller(n)(v), n * 2, chars))
        power = BASE ** (n // 2)

        def packed_of(v: Column) -> Column:
            return F.transform(
                F.slice(v, 1, F.size(v) - (K - 1)),
                lambda x, i: F.pmod(x * F.lit(power) + F.get(v, i + n), F.lit(PRIME)) * F.lit(_HIGH) - (first + i),
            )

        return _let(hashes, lambda v: chosen(packed_of(v), 1, chars))

    def chosen(least: Column, n: int, chars: Column) -> Column:
        if n < WINDOW:
            return _let(least, lambda v: chosen(_minimiser(n)(v), n * 2, chars))
        windows = F.greatest(F.lit(1), F.size(chars) - (K + WINDOW - 2))
        return F.array_distinct(F.slice(least, 1, windows))

    return _let(F.split(text, ""), of)


def _long(text: Column, n: Column, first: Column) -> Column:
    """Packed choices of a text of ``n`` >= K characters that starts at ``first``."""
    windows = F.greatest(F.lit(1), n - (K + WINDOW - 2))
    starts = F.sequence(F.lit(0), ((windows - 1) / BLOCK).cast("int"))
    parts = F.transform(
        starts,
        lambda b: _block(F.substring(text, b * BLOCK + 1, F.lit(BLOCK + K + WINDOW - 2)), first + b * BLOCK),
    )
    return F.when(windows <= BLOCK, _block(text, first)).otherwise(F.array_distinct(F.flatten(parts)))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def packed(text: Column) -> Column:
    """The fingerprint of a text as packed integers, by position."""
    n = F.char_length(text)
    whole = F.xxhash64(text).bitwiseAND(F.lit(PRIME)) * F.lit(_HIGH)
    return F.when(n >= K, _long(text, n, F.lit(0))).when(n > 0, F.array(whole)).otherwise(_none())


def _hash(choice: Column) -> Column:
    return F.shiftright(choice + F.lit(_HIGH - 1), 32)


def _position(choice: Column) -> Column:
    return F.negate(choice).bitwiseAND(F.lit(_HIGH - 1))


def _beginning(choices: Column, n: Column) -> Column:
    """The choices of the windows within the first ``n`` characters of a text, of all its choices.

    ``n`` is a full window's characters at least. Choices move on with their
    windows, so these are those up to the choice of the last such window.
    """

    def up_to(last: Column) -> Column:
        return F.filter(choices, lambda x: _position(x) <= last)

    def within(x: Column) -> Column:
        return (_position(x) >= n - (K + WINDOW - 1)) & (_position(x) <= n - K)

    return _let(_position(F.array_min(F.filter(choices, within))), up_to)


def unpacked(choices: Column) -> Column:
    """array<struct<hash bigint, position bigint>> of packed integers."""
    return F.transform(
        choices,
        lambda x: F.struct(_hash(x).alias("hash"), _position(x).alias("position")),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint array<struct<hash, position>>) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), unpacked(packed(text)).alias("fingerprint"))


def hashes(choices: Column) -> Column:
    """The distinct hashes of packed choices."""
    return F.array_distinct(F.transform(choices, lambda v: _hash(v)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    ratio = _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(ratio)


def edited_next(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    of_choices: Callable[[Column], Column] = lambda choices: choices,
    work: Workspace | None = None,
) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next text.

    ``of_choices`` is what to return of the packed choices, for instance a
    digest; what it leaves out is not carried through the last window.

    The next document is the following one by id (of any type that can be
    ordered), then by the hash of its text; after the last comes the first.
    Rows are dealt to ranges of that order, however many they are, and the
    first row of a range is copied to the one before, so each range is worked
    off alone; rows of one id are split by their texts. Rows that are equal in
    both and more than ``HOT_ROWS`` are worked off as one: all but the last
    have an equal text next.
    Every text is worked off once: choices of windows that end before the edit,
    and of the next text's windows within what is put there, serve the edited
    text too, and only windows across the edit's begin are worked off again.
    """
    work = work or Workspace(docs.sparkSession, "winnow")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    key = F.struct("id", "text_hash").alias("key")
    keys = work.save(own.select(key).groupBy("key").agg(F.count("*").alias("n")), "keys")
    ranges = Ranges(keys, work, BUCKET_ROWS)
    least = Window.orderBy("b")  # as many rows as ranges
    firsts = ranges.of(keys, "key", "b").groupBy("b").agg(F.min("key").alias("key"))
    last = F.max("b").over(Window.partitionBy())
    firsts = work.save(firsts.select("key", F.coalesce(F.lag("b").over(least), last).alias("before")), "firsts")
    # at most MOST_RANGES values
    hot = keys.where(F.col("n") > max(HOT_ROWS, (keys.agg(F.sum("n")).first()[0] or 0) // MOST_RANGES))
    own = own.withColumn("key", key)
    folded = not hot.isEmpty()
    if folded:
        hot = F.broadcast(hot.select("key", F.col("n").alias("times")))
        once = own.join(hot, "key", "left_anti").withColumn("times", F.lit(1).cast("long"))
        own = once.unionByName(own.join(hot, "key").dropDuplicates(["key"]))
    else:
        own = own.withColumn("times", F.lit(1).cast("long"))
    places = F.array_compact(
        F.array(
            F.struct(F.col("b"), F.lit(0).alias("copy")),
            F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("b"), F.lit(1).alias("copy"))),
        )
    )
    moved = (
        ranges.of(own, "key", "b")
        .join(F.broadcast(firsts), "key", "left")
        .select("id", "text", "text_hash", "times", F.explode(places).alias("p"))
        .select("id", "text", "text_hash", "times", "p.b", "p.copy")
    )
    order = Window.partitionBy("b").orderBy("copy", F.col("id").asc_nulls_first(), "text_hash", F.desc("again"))
    moved = moved.withColumn("again", F.lit(0)).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    if folded:
        itself = F.struct(F.lit(1).alias("again"), (F.col("times") - 1).alias("times"), F.col("text").alias("next_text"))
        ways = F.array_compact(
            F.array(F.when(F.col("times") > 1, itself), F.struct("again", F.lit(1).cast("long").alias("times"), "next_text"))
        )
        moved = moved.select("id", "text", "text_hash", "b", "copy", F.explode(ways).alias("w")).select("*", "w.*").drop("w")
    overlap = K + WINDOW - 2
    rows = moved.withColumn("print", packed(F.col("text"))).withColumn("next_print", F.lead("print").over(order)).where("copy = 0")
    rows = (
        rows.withColumn("n", F.char_length("text"))
        .withColumn("kept", F.col("n") - F.expr("n div 4").cast("int"))
        .withColumn("put", F.substring(F.col("next_text"), F.lit(1), F.expr("n div 4").cast("int")))
        .drop("next_text")
        .withColumn("n_put", F.char_length("put"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), "put"))
        .drop("text", "put")
    )
    # windows on both sides of the edit's begin
    ts = F.col("kept") - overlap
    joint_n = overlap + F.least("n_put", F.lit(overlap))
    joint = F.when(F.col("n_put") > 0, _long(F.substring(F.col("edited"), ts + 1, joint_n), joint_n, ts)).otherwise(_none())
    moved_on = F.when(
        F.col("n_put") > overlap, F.transform(_beginning(F.col("next_print"), F.col("n_put")), lambda x: x - F.col("kept"))
    ).otherwise(_none())
    edited_print = F.array_distinct(F.concat(_beginning(F.col("print"), F.col("kept")), joint, moved_on))
    rows = (
        rows.withColumn("edited_print", F.when(F.col("kept") > overlap, edited_print).otherwise(packed(F.col("edited"))))
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .withColumn("own", hashes(F.col("print")))
        .withColumn("next", hashes(F.col("next_print")))
        .select(
            "id",
            "times",
            "n",
            "edited_sha256",
            of_choices(F.col("print")).alias("choices"),
            of_choices(F.col("edited_print")).alias("edited_choices"),
            _let(hashes(F.col("edited_print")), lambda edited: likeness(F.col("own"), edited)).alias("near_edited"),
            "own",
            "next",
        )
    )
    if folded:
        rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        "choices",
        "edited_choices",
        "near_edited",
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def digest(choices: Column) -> Column:
    """sha256 of the packed integers, in order."""
    return F.sha2(choices.cast("string").cast("binary"), 256)
