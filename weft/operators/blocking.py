"""Candidate pairs: key tables, capped postings, inverted-index joins, passes and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import grams


def keys(records: DataFrame, entity: str, parts: dict[str, Column], label: str = "cty") -> DataFrame:
    """(label, entity, key): distinct keys of every record, prefixed by their kind; nulls and empty ones go.

    A part is a string column or an array of strings.
    """
    kinds = dict(records.select(*[c.alias(p) for p, c in parts.items()]).dtypes)
    every = F.concat(*[F.transform(_listed(c, kinds[p]), _prefixed(p)) for p, c in parts.items()])
    return records.select(F.col(label), F.col(entity), F.explode(F.array_distinct(every)).alias("key"))


def _listed(column: Column, kind: str) -> Column:
    listed = column if kind.startswith("array") else F.array(column)
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))


def _prefixed(prefix: str):
    return lambda k: F.concat(F.lit(f"{prefix}:"), k)


def gram_keys(column: Column, n: int = 4) -> Column:
    return F.array_distinct(grams(column, n))


def bigram_keys(words: Column) -> Column:
    """A number and the word after it."""
    places = F.sequence(F.lit(1), F.size(words) - 1)
    pairs = F.transform(places, lambda i: F.concat(F.element_at(words, i), F.lit("_"), F.element_at(words, i + 1)))
    numbered = F.filter(pairs, lambda k: k.rlike("^[0-9]"))
    return F.when(F.size(words) > 1, numbered).otherwise(F.array().cast("array<string>"))


def cap(pool: int, share: float, least: int = 20) -> int:
    """Most records a key may have in a pool."""
    return max(least, int(-(-share * pool // 1)))


def postings(keyed: DataFrame, totals: DataFrame, share: float, least: int = 20, label: str = "cty") -> DataFrame:
    """Keys that few enough records of the label have, with idf = ln(records / records with the key).

    ``totals``: (label, n). Frequent keys go before any join, which is what
    keeps a join's output, and so its skew, bounded by the cap.
    """
    most = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("n")))
    counts = keyed.groupBy(label, "key").agg(F.count("*").alias("df"))
    rare = counts.join(F.broadcast(totals), label).where(F.col("df") <= most)
    return keyed.join(rare.select(label, "key", "df", F.log(F.col("n") / F.col("df")).alias("idf")), [label, "key"])


def index_join(
    queries: DataFrame, posted: DataFrame, k: int, query: str, entity: str, label: str = "cty", digits: int = 6
) -> DataFrame:
    """(label, query, entity, score, n_keys, rank): sum of idf over shared keys, the ``k`` best of each query.

    Equal scores are ordered by the smaller entity.
    """
    pairs = (
        queries.select(label, query, "key")
        .join(posted.select(label, entity, "key", "idf"), [label, "key"])
        .groupBy(label, query, entity)
        .agg(F.round(F.sum("idf"), digits).alias("score"), F.count("*").alias("n_keys"))
    )
    return top(pairs, [label, query], [F.desc("score"), F.col(entity)], k)


def top(rows: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    place = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(place)).where(F.col(rank) <= k)


def union_passes(passes: dict[str, DataFrame], pair: list[str]) -> DataFrame:
    """One row per pair: score and rank of every pass (null where it did not find the pair) and ``n_passes``."""
    stacked = None
    for name, found in passes.items():
        one = found.select(*pair, F.lit(name).alias("pass"), "score", "rank")
        stacked = one if stacked is None else stacked.unionByName(one)
    columns = []
    for name in passes:
        own = F.col("pass") == name
        columns += [F.max(F.when(own, F.col("score"))).alias(f"score_{name}"), F.max(F.when(own, F.col("rank"))).alias(f"rank_{name}")]
    return stacked.groupBy(*pair).agg(*columns, F.count("*").alias("n_passes"))


def filled(wide: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Scores 0 and rank k + 1 where a pass did not find the pair, with ln(1 + rank) and a found flag."""
    for name, k in ranks.items():
        wide = (
            wide.withColumn(f"found_{name}", F.col(f"score_{name}").isNotNull().cast("int"))
            .withColumn(f"score_{name}", F.coalesce(f"score_{name}", F.lit(0.0)))
            .withColumn(f"lrank_{name}", F.log1p(F.coalesce(f"rank_{name}", F.lit(k + 1))))
        )
    return wide


def duplicate_groups(records: DataFrame, entity: str, key: Column, least: int = 2, most: int = 6, label: str = "cty") -> DataFrame:
    """(label, entity, gid): records of one label with the same key, in groups of ``least`` to ``most``."""
    keyed = records.select(label, entity, key.alias("gid")).where(F.col("gid") != "")
    sizes = keyed.groupBy(label, "gid").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return keyed.join(sizes.select(label, "gid"), [label, "gid"], "left_semi")


def add_mates(
    found: DataFrame, groups: DataFrame, query: str, entity: str, seeds: Column, best: str, most: int = 5, label: str = "cty"
) -> DataFrame:
    """New pairs with the duplicates of seeded candidates, at most ``most`` a query by best rank, then smaller entity."""
    mates = groups.select(F.col(label), F.col("gid"), F.col(entity).alias("__mate"))
    new = (
        found.where(seeds)
        .select(label, query, entity, best)
        .join(groups, [label, entity])
        .join(mates, [label, "gid"])
        .where(F.col("__mate") != F.col(entity))
        .groupBy(label, query, F.col("__mate").alias(entity))
        .agg(F.min(best).alias(best))
        .join(found.select(label, query, entity), [label, query, entity], "left_anti")
    )
    return top(new, [label, query], [F.col(best), F.col(entity)], most)


def report(candidates: DataFrame, truth: DataFrame, n_left: DataFrame, n_right: DataFrame, left: str = "i1", right: str = "i23", label: str = "cty") -> DataFrame:
    """Per label: pairs, completeness, quality, reduction ratio and pairs a query. ``n_*``: (label, n)."""
    hit = candidates.join(truth.select(label, left, right).withColumn("__t", F.lit(1)), [label, left, right], "left")
    got = hit.groupBy(label).agg(F.count("*").alias("pairs"), F.count("__t").alias("hits"))
    known = truth.groupBy(label).agg(F.count("*").alias("truth"))
    return (
        n_left.withColumnRenamed("n", "n_left")
        .join(n_right.withColumnRenamed("n", "n_right"), label)
        .join(got, label, "left")
        .join(known, label, "left")
        .na.fill(0, ["pairs", "hits", "truth"])
        .select(
            label,
            "pairs",
            "truth",
            "hits",
            F.when(F.col("truth") > 0, F.col("hits") / F.col("truth")).alias("completeness"),
            F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).alias("quality"),
            (1 - F.col("pairs") / (F.col("n_left") * F.col("n_right"))).alias("reduction"),
            (F.col("pairs") / F.col("n_left")).alias("pairs_per_query"),
        )
    )


def list_report(candidates: DataFrame, truth: DataFrame, entities: DataFrame, left: str = "i1", right: str = "i23") -> DataFrame:
    """One row: mean, 95th percentile and longest list, share of matched entities with all matches found, and macro F0.5 of a perfect judge."""
    sizes = candidates.groupBy(left).agg(F.count("*").alias("n"))
    lists = sizes.agg(F.sum("n").alias("pairs"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("longest"))
    hits = truth.join(candidates.select(left, right).distinct(), [left, right], "left_semi").groupBy(left).agg(F.count("*").alias("tp"))
    per = entities.select(left).join(truth.groupBy(left).agg(F.count("*").alias("n_true")), left, "left").join(hits, left, "left").na.fill(0, ["n_true", "tp"])
    # a perfect judge takes just the matches among the candidates
    f = F.when(F.col("n_true") == 0, F.lit(1.0)).otherwise(5 * F.col("tp") / (4 * F.col("tp") + F.col("n_true")))
    found = F.when(F.col("n_true") > 0, (F.col("tp") == F.col("n_true")).cast("double"))
    judged = per.agg(F.count("*").alias("__n"), F.avg(found).alias("ceiling"), F.avg(F.coalesce(f, F.lit(0.0))).alias("oracle_f05"))
    rows = lists.join(F.broadcast(judged))  # one row each
    return rows.select((F.col("pairs") / F.col("__n")).alias("mean"), "p95", "longest", "ceiling", "oracle_f05")


def pass_report(candidates: DataFrame, truth: DataFrame, passes: dict[str, Column], left: str = "i1", right: str = "i23") -> DataFrame:
    """(pass, recall_alone, only_by_this): share of all matches that a pass found, and that no other did."""
    names = list(passes)
    marked = candidates.select(left, right, *[c.cast("int").alias(n) for n, c in passes.items()])
    hits = truth.select(left, right).join(marked, [left, right], "left").na.fill(0, names)
    total = sum((F.col(n) for n in names), F.lit(0))
    sums = []
    for n in names:
        sums += [F.avg(F.col(n)).alias(f"a_{n}"), F.avg(((F.col(n) == 1) & (total == 1)).cast("double")).alias(f"o_{n}")]
    rows = [F.struct(F.lit(n).alias("pass"), F.col(f"a_{n}").alias("recall_alone"), F.col(f"o_{n}").alias("only_by_this")) for n in names]
    return hits.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
