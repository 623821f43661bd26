"""URL filters: host and path rules, and a Bloom filter cascade for listed domains.

DataFrame functions only. Level 1 of the cascade is a Bloom filter over the
listed keys; level 2 over the keys of the corpus that level 1 wrongly lets
through; level 3 over the listed keys that level 2 wrongly lets through, and
so on until a level makes no mistake. Over the corpus's complete key
universe, which the levels were built against, membership is then exact, and
a row needs no join: the filters are literals of the plan.

The filters grow with the list, so their size is checked: a level of more
than ``MOST_BITS`` bits raises the number of shards, each with a cascade of
its own over the keys that hash to it, and with more than ``MOST_SHARDS``
shards a semi join by key decides instead, with the same result.

Edge cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null keys in a list are ignored; an empty list
allows everything; an empty table gives an empty result; repeated rows are
kept; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Workspace

MOST_BITS = 1 << 20
MOST_SHARDS = 16

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Domains blocked with all their subdomains where no rule fits.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name = F.when(fits, F.lit(of + start)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c. Empty for an empty host."""
    labels = F.split(host, "\\.")
    all_ = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(F.length(host) > 0, all_).otherwise(F.array().cast("array<string>"))


@dataclass
class Level:
    """One Bloom filter: its bits as 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        first = F.xxhash64(key, F.lit(self.number)).bitwiseAND(F.lit((1 << 61) - 1))
        step = F.xxhash64(key, F.lit(-self.number)).bitwiseAND(F.lit((1 << 32) - 1))
        return [(first + step * F.lit(j)) % F.lit(self.bits) for j in range(self.hashes)]

    def has(self, key: Column) -> Column:
        words = F.array(*[F.lit(w) for w in self.words])
        found = F.lit(True)
        for p in self.positions(key):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            found = found & _bit(word, p)
        return found


def _bit(word: Column, position: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, (position % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def _level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A filter over the column ``key`` with about this rate of false positives."""
    bits = max(64, 64 * math.ceil(count * math.log(1 / rate) / math.log(2) ** 2 / 64))
    level = Level(number, bits, max(1, round(math.log2(1 / rate))), [])
    words = (
        keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
        .select(F.shiftright("p", 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .collect()  # at most MOST_BITS / 64 words
    )
    full = [0] * (bits // 64)
    for r in words:
        full[r["w"]] = r["b"]
    level.words = full
    return level


class Cascade:
    """Exact membership over a universe of keys, as an expression."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.has(key) & ~found
        return found


def cascade(listed: DataFrame, universe: DataFrame, work: Workspace, name: str = "c") -> Cascade:
    """The cascade for ``listed`` over ``universe`` (both distinct, not null, in column ``key``)."""
    others = universe.join(listed, "key", "left_anti")
    inside, outside, levels = listed, others, []
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        number = len(levels) + 1
        rate = min(0.5, max(1e-6, math.sqrt(0.5) * n_in / max(n_out, 1))) if number == 1 else 0.5
        levels.append(_level(inside, n_in, rate, number))
        wrong = work.save(outside.where(levels[-1].has(F.col("key"))), f"{name}{number}")
        inside, outside = wrong, inside
        n_in, n_out = wrong.count(), n_in
    return Cascade(levels)


def blocked(
    pages: DataFrame,
    listed: DataFrame,
    url_col: str = "url",
    out: str = "listed",
    work: Workspace | None = None,
    most_bits: int = MOST_BITS,
    most_shards: int = MOST_SHARDS,
) -> DataFrame:
    """``pages`` with a boolean ``out``: whether the host or a parent domain is in ``listed`` (column ``key``)."""
    spark = pages.sparkSession
    work = work or Workspace(spark, "urls")
    keys = work.save(listed.select(F.col("key").cast("string")).where("key is not null").distinct(), "listed")
    own = domains(host_and_path(F.col(url_col))[0])
    universe = work.save(pages.select(F.explode(own).alias("key")).distinct(), "universe")
    n, total = keys.count(), universe.count()
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n / max(total, 1)))
    shards = max(1, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / most_bits))
    if shards > most_shards:
        hit = universe.join(keys, "key", "left_semi").withColumnRenamed("key", "__key")
        marked = pages.withColumn("__row", F.monotonically_increasing_id())
        marked = work.save(marked, "rows")
        found = marked.select("__row", F.explode(own).alias("__key")).join(hit, "__key").select("__row").distinct()
        return marked.join(found.withColumn(out, F.lit(True)), "__row", "left").withColumn(
            out, F.coalesce(out, F.lit(False))
        ).drop("__row")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    parts = [
        cascade(keys.where(shard == s), universe.where(shard == s), work, f"s{s}-") for s in range(shards)
    ]

    def member(key: Column) -> Column:
        found = F.lit(False)
        for s, part in enumerate(parts):
            found = F.when(F.pmod(F.xxhash64(key), F.lit(shards)) == s, part.has(key)).otherwise(found)
        return found if shards > 1 else parts[0].has(key)

    return pages.withColumn(out, F.exists(own, member))


def judge(
    pages: DataFrame, rules=RULES, listed=LISTED, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row: the longest fitting rule, else the listed domains."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    keys = spark.createDataFrame([(d,) for d in listed], "key string")
    marked = blocked(own, keys)
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        marked.withColumn("host", host)
        .withColumn("path", path)
        .select(
            F.col(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "listed"
        )
    )
