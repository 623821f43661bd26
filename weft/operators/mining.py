"""Variant mining: aligned tokens of matched against other pairs, lift, canonical tables, seeds without labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as S
from weft.functions import text as X
from weft.operators.parse import UNIT_MARKS

#: Canonical tokens are never replaced.
PROTECTED = frozenset(X.WORD_FORMS.values()) | UNIT_MARKS | X.LEGAL_FORMS | X.STOP_WORDS


#: Longest names whose words are compared place by place, and the least closeness of a pair.
PLACES, LEAST = 3, 0.85


def _sound_alike(x: str, y: str) -> float:
    """Closeness by sound; 0 for words too short to tell."""
    a, b = X.sound_key(x), X.sound_key(y)
    return S.jaro_winkler(a, b) if min(map(len, (x, y, a, b))) >= 3 else 0.0


def _spelled_alike(x: str, y: str) -> float:
    short, long = sorted((x, y), key=len)
    return max(S.jaro_winkler(x, y), 0.95 * S.is_abbreviation(short, long))


def closeness(left: Column, right: Column) -> Column:
    """array<array<double>>: how close each left word is to each right one.

    Few words of equal number are only close to the one in the same place, by sound.
    """

    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def table(a, b) -> list[list[float]]:
            if len(a) == len(b) <= PLACES:
                return [[_sound_alike(p, q) if i == j else 0.0 for j, q in enumerate(b)] for i, p in enumerate(a)]
            return [[_spelled_alike(p, q) for q in b] for p in a]

        return pd.Series([table(a, b) for a, b in zip(x, y, strict=True)], dtype=object)

    return run(left, right)


def aligned(pairs: DataFrame, a: str, b: str, out: str = "aligned") -> DataFrame:
    """Add ``out``, array<struct<x, y>>: words of two arrays that stand for each other, x < y.

    Words in both, and words with digits, take no part. The words of ``a``
    choose in turn, each the closest word of ``b`` that is free (of equals the
    first), if it is close enough. Null arrays count as empty.
    """
    none = F.array().cast("array<string>")
    own, other = F.coalesce(F.col(a), none), F.coalesce(F.col(b), none)

    def differing(words: Column, seen: Column) -> Column:
        return F.filter(words, lambda t: (t != "") & ~F.array_contains(seen, t) & ~t.rlike("[0-9]"))

    df = pairs.withColumns({"__l": differing(own, other), "__r": differing(other, own)})
    df = df.withColumn("__c", closeness(F.col("__l"), F.col("__r")))
    free = F.transform("__r", lambda t, j: j)
    start = F.struct(free.alias("free"), F.array().cast("array<struct<x:string,y:string>>").alias("made"))

    def choose(state: Column, i: Column) -> Column:
        offers = F.transform(state["free"], lambda j: F.struct(F.get(F.get("__c", i), j).alias("close"), (-j).alias("place")))
        best = F.array_max(offers)
        x, y = F.get("__l", i), F.get("__r", -best["place"])
        pair = F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
        taken = F.struct(
            F.filter(state["free"], lambda j: j != -best["place"]).alias("free"), F.concat(state["made"], F.array(pair)).alias("made")
        )
        return F.when(best["close"] >= LEAST, taken).otherwise(state)

    places = F.transform("__l", lambda t, i: i)
    return df.withColumn(out, F.aggregate(places, start, choose)["made"]).drop("__l", "__r", "__c")


def segments_alike(x: Column, y: Column) -> Column:
    """Whether two segments are one: initials or an abbreviation of the other, or alike by sound."""
    a, b = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    initials = lambda s: F.array_join(F.transform(F.split(s, " +"), lambda w: F.substring(w, 1, 1)), "")

    def abbreviates(short: Column, long: Column) -> Column:
        inside = F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*"))
        fits = (F.length(short) >= 1) & (F.length(short) <= 5) & (F.length(short) < F.length(long)) & short.rlike("^[a-z0-9]*$")
        return F.when(fits, F.rlike(long, inside)).otherwise(F.lit(False))

    sounds = S.of_columns(S.jaro_winkler, X.sound_key_col(a), X.sound_key_col(b))
    spoken = (F.least(F.length(a), F.length(b)) >= 4) & (sounds >= LEAST)
    return (initials(x) == b) | (initials(y) == a) | abbreviates(a, b) | abbreviates(b, a) | spoken


def counts(pairs: DataFrame, a: str, b: str, label: str = "cty") -> DataFrame:
    """(label, x, y, k): how often two words stand for each other."""
    found = aligned(pairs.select(label, a, b), a, b).select(label, F.explode("aligned").alias("p"))
    return found.groupBy(label, "p.x", "p.y").agg(F.count("*").alias("k"))


def with_lift(positive: DataFrame, negative: DataFrame, n_positive: int, n_negative: int, keys: list[str], support: int = 5) -> DataFrame:
    """Pairs with enough support: rate among matched pairs over the smoothed rate among others."""
    rows = positive.where(F.col("k") >= support).join(negative.withColumnRenamed("k", "neg"), keys, "left").na.fill(0, ["neg"])
    lift = (F.col("k") / F.lit(n_positive)) / ((F.col("neg") + 0.5) / F.lit(n_negative))
    return rows.withColumn("lift", lift)


def similar(x: Column, y: Column) -> Column:
    """Whether two single words are spelled alike or one abbreviates the other."""
    short = F.least(F.length(x), F.length(y)) < 3
    close = S.of_columns(lambda a, b: _spelled_alike(a, b), x, y)
    abbreviation = S.of_columns(lambda a, b: float(S.is_abbreviation(*sorted((a, b), key=len))), x, y)
    single = ~F.contains(F.concat(x, y), F.lit(" "))
    return single & ((~short & (close >= LEAST)) | (abbreviation > 0))


def canonical(lifted: DataFrame, frequency: DataFrame, label: str = "cty", least: float = 10.0, least_similar: float = 2.0) -> DataFrame:
    """(label, variant, form): the rarer word becomes the more frequent one; by support, no chains, protected words stay.

    ``frequency``: (token, n).
    """
    protected = sorted(PROTECTED)
    strong = lifted.where((F.length("x") > 1) & (F.length("y") > 1)).where(
        F.col("lift") >= F.when(similar(F.col("x"), F.col("y")), F.lit(least_similar)).otherwise(F.lit(least))
    )
    seen = strong.join(frequency.select(F.col("token").alias("x"), F.col("n").alias("nx")), "x", "left").join(
        frequency.select(F.col("token").alias("y"), F.col("n").alias("ny")), "y", "left"
    ).na.fill(0, ["nx", "ny"])
    rarer = F.struct("nx", "x") < F.struct("ny", "y")
    low, high = F.when(rarer, F.col("x")).otherwise(F.col("y")), F.when(rarer, F.col("y")).otherwise(F.col("x"))
    sided = seen.select(label, "k", low.alias("low"), high.alias("high"))
    turned = sided.withColumn("keep", F.col("low").isin(protected))
    rows = turned.select(
        label,
        "k",
        F.when(F.col("keep"), F.col("high")).otherwise(F.col("low")).alias("variant"),
        F.when(F.col("keep"), F.col("low")).otherwise(F.col("high")).alias("form"),
    ).where(~F.col("variant").isin(protected))
    best = rows.groupBy(label, "variant").agg(F.min_by("form", F.struct(-F.col("k"), F.col("form"))).alias("form"))
    chained = best.select(label, F.col("variant").alias("form"))
    return best.join(chained, [label, "form"], "left_anti").where("form <> variant").select(label, "variant", "form")


def tables(
    positive: DataFrame, negative: DataFrame, a: str, b: str, label: str = "cty", support: int = 5, least: float = 10.0, least_similar: float = 2.0
) -> DataFrame:
    """(label, variant, form) mined from pairs of word arrays that do and do not match, for each label and '*' for all.

    A label's own form of a word overrides that of all labels.
    """
    found = []
    for name in (label, "*"):
        own = [p.withColumn(label, F.lit("*")) if name == "*" else p for p in (positive, negative)]
        sizes = [p.groupBy(label).agg(F.count("*").alias(n)) for p, n in zip(own, ("n_pos", "n_neg"), strict=True)]
        yes, no = (counts(p, a, b, label) for p in own)
        rows = yes.where(F.col("k") >= support).join(no.withColumnRenamed("k", "neg"), [label, "x", "y"], "left").na.fill(0, ["neg"])
        rows = rows.join(F.broadcast(sizes[0]), label).join(F.broadcast(sizes[1]), label)  # as many rows as labels
        lifted = rows.withColumn("lift", (F.col("k") / F.col("n_pos")) / ((F.col("neg") + 0.5) / F.col("n_neg")))
        words = [p.select(F.explode(c).alias("token")) for p in own for c in (a, b)]
        every = words[0]
        for w in words[1:]:
            every = every.unionByName(w)
        found.append(canonical(lifted, every.groupBy("token").agg(F.count("*").alias("n")), label, least, least_similar))
    return found[0].unionByName(found[1])


def forms_of(mined: DataFrame, label: str = "cty") -> dict[str, dict[str, str]]:
    """{label: {variant: form}} of a mined table, which is bounded by its support; labels inherit the forms of '*'."""
    out: dict[str, dict[str, str]] = {}
    for r in mined.collect():
        out.setdefault(r[label], {})[r["variant"]] = r["form"]
    return {name: {**out.get("*", {}), **own} for name, own in out.items()}


def seeds(candidates: DataFrame, left: DataFrame, right: DataFrame, label: str = "cty", least: float = 0.9) -> DataFrame:
    """Sure pairs without labels: each other's best candidate, with the same words or the same house and a close name.

    ``candidates``: (label, i1, i23, score, rank); records: (label, id, k_sorted, k_joined, house).
    """
    from pyspark.sql.window import Window

    back = F.row_number().over(Window.partitionBy(label, "i23").orderBy(F.desc("score"), "i1"))
    mutual = candidates.withColumn("back", back).where("rank = 1 and back = 1").select(label, "i1", "i23")
    a = left.select(label, F.col("id").alias("i1"), F.struct("k_sorted", "k_joined", "house").alias("a"))
    b = right.select(label, F.col("id").alias("i23"), F.struct("k_sorted", "k_joined", "house").alias("b"))
    rows = mutual.join(a, [label, "i1"]).join(b, [label, "i23"])
    close = S.of_columns(S.jaro_winkler, F.col("a.k_joined"), F.col("b.k_joined"))
    same_house = (F.col("a.house") != "") & (F.col("a.house") == F.col("b.house"))
    return rows.withColumn("jw", close).where((F.col("a.k_sorted") == F.col("b.k_sorted")) | (same_house & (F.col("jw") >= least))).select(label, "i1", "i23")
