"""From scored edges to lists: calibration, exclusivity, thresholds, expected F, votes, propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.blocking import top


def exclusive(edges: DataFrame, margin: float = 0.0, penalty: float = 1.0, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """Each record's best edge; its score times ``penalty`` if a second one is closer than ``margin``. Ties: smaller left id."""
    order = Window.partitionBy(right).orderBy(F.desc(p), F.col(left))
    ranked = edges.select(left, right, p, F.row_number().over(order).alias("r"), F.lead(p).over(order).alias("p2"))
    close = F.col("p2").isNotNull() & (F.col(p) - F.col("p2") < margin)
    return ranked.where("r = 1").select(left, right, F.when(close, F.col(p) * penalty).otherwise(F.col(p)).alias(p))


def threshold(edges: DataFrame, least: float, most: int = 10, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """Edges of at least a score, the ``most`` best of each entity."""
    return top(edges.where(F.col(p) >= least), [left], [F.desc(p), F.col(right)], most)


def expected_f(
    edges: DataFrame, floor: float = 0.1, most: int = 10, empty: Column | float = 0.5, missed: float = 0.0,
    left: str = "i1", right: str = "i23", p: str = "p",
) -> DataFrame:
    """(left, n_selected, expected): the list length with the largest expected F0.5, shorter ones first.

    Over the ``most`` best edges from ``floor`` on, the distribution of the
    number of true ones among the first k is carried from k to k + 1 in one
    array expression; all edges' scores count towards the expected number of
    true ones left out. The empty list is worth ``empty``. Entities without a
    selectable edge give no row.
    """
    totals = edges.groupBy(left).agg(F.sum(p).alias("total"))
    kept = top(edges.where(F.col(p) >= floor), [left], [F.desc(p), F.col(right)], most)
    lists = kept.groupBy(left).agg(F.sort_array(F.collect_list(p), asc=False).alias("ps"))  # at most `most`
    rows = lists.join(totals, left)

    def value(dist: Column, k: Column, taken: Column) -> Column:
        unseen = F.greatest(F.col("total") - taken, F.lit(0.0)) + F.lit(missed)
        terms = F.transform(
            dist, lambda w, t: F.when(t > 0, w * 5 * t / (5 * t + unseen + 4 * (k - t))).otherwise(F.lit(0.0))
        )
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, q: Column) -> Column:
        old = state["dist"]
        grown = F.concat(old, F.array(F.lit(0.0)))
        dist = F.transform(grown, lambda w, t: w * (1 - q) + F.when(t > 0, F.get(old, t - 1) * q).otherwise(F.lit(0.0)))
        k, taken = state["k"] + 1, state["taken"] + q
        return F.struct(dist.alias("dist"), k.alias("k"), taken.alias("taken"), state["best_k"].alias("best_k"), state["best"].alias("best"))

    def scored(state: Column) -> Column:
        found = value(state["dist"], state["k"].cast("double"), state["taken"])
        better = found > state["best"]
        return F.struct(
            state["dist"].alias("dist"),
            state["k"].alias("k"),
            state["taken"].alias("taken"),
            F.when(better, state["k"]).otherwise(state["best_k"]).alias("best_k"),
            F.when(better, found).otherwise(state["best"]).alias("best"),
        )

    start = F.struct(
        F.array(F.lit(1.0)).alias("dist"),
        F.lit(0).alias("k"),
        F.lit(0.0).alias("taken"),
        F.lit(0).alias("best_k"),
        (F.lit(empty) if isinstance(empty, float) else empty).cast("double").alias("best"),
    )
    # a struct bound by a one-element array is computed once before it is scored
    chosen = F.aggregate("ps", start, lambda s, q: F.element_at(F.transform(F.array(step(s, q)), scored), 1))
    return rows.select(left, chosen.alias("c")).select(left, F.col("c.best_k").alias("n_selected"), F.col("c.best").alias("expected"))


def select_top(edges: DataFrame, lengths: DataFrame, floor: float, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """The first ``n_selected`` edges of each entity."""
    ranked = top(edges.where(F.col(p) >= floor), [left], [F.desc(p), F.col(right)], 1 << 30)
    return ranked.join(lengths, left).where(F.col("rank") <= F.col("n_selected")).select(left, right, p)


def cost_table(edges: DataFrame, truth: DataFrame, most: int = 8, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """(left, k, cost): 1 - F0.5 of taking the first k edges, for k from 0 on."""
    known = truth.groupBy(left).agg(F.count("*").alias("n_true"))
    ranked = top(edges, [left], [F.desc(p), F.col(right)], most)
    hits = ranked.join(truth.withColumn("__t", F.lit(1)), [left, right], "left")
    running = Window.partitionBy(left).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    firsts = hits.select(left, F.col("rank").alias("k"), F.count("__t").over(running).alias("tp"))
    none = edges.select(left).distinct().select(left, F.lit(0).alias("k"), F.lit(0).cast("long").alias("tp"))
    rows = firsts.unionByName(none).join(known, left, "left").na.fill(0, ["n_true"])
    f = F.when((F.col("k") == 0) & (F.col("n_true") == 0), F.lit(1.0)).otherwise(
        5 * F.col("tp") / (5 * F.col("tp") + (F.col("n_true") - F.col("tp")) + 4 * (F.col("k") - F.col("tp")))
    )
    return rows.select(left, "k", (1 - f).alias("cost"))


def propagate(edges: DataFrame, links: DataFrame, least: float = 0.95, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """One hop: a record gets its linked mate's score times the link's if that is more. ``links``: (left, x, y, p_link)."""
    strong = links.where(F.col("p_link") >= least)
    ways = strong.select(left, F.col("x").alias(right), F.col("y").alias("__m"), "p_link").unionByName(
        strong.select(left, F.col("y").alias(right), F.col("x").alias("__m"), "p_link")
    )
    mates = edges.select(left, F.col(right).alias("__m"), F.col(p).alias("__p"))
    lifted = ways.join(mates, [left, "__m"]).groupBy(left, right).agg(F.max(F.col("p_link") * F.col("__p")).alias("__up"))
    return edges.join(lifted, [left, right], "left").withColumn(p, F.greatest(F.col(p), F.coalesce("__up", F.lit(0.0)))).drop("__up")


def vote(results: dict[str, DataFrame], preferred: str, least: int = 2, left: str = "i1", right: str = "i23") -> DataFrame:
    """Pairs of at least ``least`` result sets, one entity a record: the preferred set's first, then most votes, then smaller id."""
    stacked = None
    for name, pairs in results.items():
        one = pairs.select(left, right, F.lit(name).alias("src"))
        stacked = one if stacked is None else stacked.unionByName(one)
    counted = stacked.groupBy(left, right).agg(
        F.countDistinct("src").alias("votes"), F.max((F.col("src") == preferred).cast("int")).alias("own")
    )
    order = Window.partitionBy(right).orderBy(F.desc("own"), F.desc("votes"), F.col(left))
    return counted.where(F.col("votes") >= least).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def priority_union(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Both sets' rows, the first set's where both have the key."""
    return first.unionByName(second.join(first.select(*key), key, "left_anti"))


def shifted(p: Column, by: Column | float) -> Column:
    """A probability moved by so many logits."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + by)))


def match_prior(edges: DataFrame, target: float, entities: int, least: float = 0.5, reach: float = 4.0, steps: int = 12, p: str = "p") -> float:
    """The shift in logits, by bisection, at which matches an entity reach the target; one job counts all 2^steps shifts."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    width = 2 * reach / (1 << steps)
    # an edge counts from the shift that lifts its logit to that of `least` on
    needed = math.log(least / (1 - least)) - F.log(q / (1 - q))
    place = F.greatest(F.lit(0), F.least(F.lit(1 << steps), F.ceil((needed + reach) / width - 1e-9))).cast("int")
    counts = {r["at"]: r["n"] for r in edges.groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()}  # at most 2^steps + 1
    low, high = 0, 1 << steps
    for _ in range(steps):
        middle = (low + high) // 2
        found = sum(n for at, n in counts.items() if at <= middle) / max(1, entities)
        low, high = (middle, high) if found < target else (low, middle)
    return (low + high) / 2 * width - reach


def grid(edges: DataFrame, truth: DataFrame, n_entities: int, thresholds: list[float], left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """(threshold, macro F0.5) of every threshold on exclusive edges, in one job; entities without any edge or truth count 1."""
    marked = edges.join(truth.withColumn("__t", F.lit(1)), [left, right], "left")
    counts = []
    for i, t in enumerate(thresholds):
        on = F.col(p) >= t
        counts += [F.count_if(on).alias(f"n{i}"), F.count_if(on & F.col("__t").isNotNull()).alias(f"tp{i}")]
    known = truth.groupBy(left).agg(F.count("*").alias("n_true"))
    per = marked.groupBy(left).agg(*counts).join(known, left, "full").na.fill(0)
    rows = per.select(
        left, "n_true", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds)])).alias("g")
    ).select(left, "n_true", "g.*")
    f = F.when((F.col("n") == 0) & (F.col("n_true") == 0), F.lit(1.0)).otherwise(
        5 * F.col("tp") / (5 * F.col("tp") + F.col("n_true") - F.col("tp") + 4 * (F.col("n") - F.col("tp")))
    )
    return rows.groupBy("threshold").agg(((F.sum(f) + (n_entities - F.count("*"))) / n_entities).alias("macro_f05"))


def tune(
    edges: DataFrame, truth: DataFrame, n_entities: int, margins: tuple = (0.0, 0.05, 0.1, 0.2), penalties: tuple = (1.0, 0.9, 0.75),
    thresholds: tuple = tuple(round(0.3 + 0.05 * i, 2) for i in range(14)), left: str = "i1", right: str = "i23", p: str = "p",
) -> DataFrame:
    """(margin, penalty, threshold, macro F0.5) of every rule; without a margin the penalty has no effect and is left out.

    The best claim and its runner-up are found once; rules only reprice it, so
    all of them are summed in one partially aggregated pass.
    """
    order = Window.partitionBy(right).orderBy(F.desc(p), F.col(left))
    best = edges.select(left, right, p, F.row_number().over(order).alias("r"), F.lead(p).over(order).alias("p2")).where("r = 1")
    marked = best.join(truth.select(left, right).distinct().withColumn("__t", F.lit(1)), [left, right], "left")
    rules = [(m, q) for m in margins for q in (penalties if m else (1.0,))]
    priced = [
        F.struct(
            F.lit(i).alias("rule"),
            F.when(F.col("p2").isNotNull() & (F.col(p) - F.col("p2") < m), F.col(p) * q).otherwise(F.col(p)).alias("q"),
        )
        for i, (m, q) in enumerate(rules)
    ]
    sums = []
    for i, t in enumerate(thresholds):
        on = F.col("q") >= t
        sums += [F.count_if(on).alias(f"n{i}"), F.count_if(on & F.col("__t").isNotNull()).alias(f"tp{i}")]
    per = marked.select(left, "__t", F.explode(F.array(*priced)).alias("x")).select(left, "__t", "x.*").groupBy(left, "rule").agg(*sums)
    known = truth.select(left, right).distinct().groupBy(left).agg(F.count("*").alias("n_true"))
    every = known.select(left, "n_true", F.explode(F.sequence(F.lit(0), F.lit(len(rules) - 1))).alias("rule"))
    per = per.join(every, [left, "rule"], "full").na.fill(0)
    cells = [F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds)]
    rows = per.select("rule", "n_true", F.explode(F.array(*cells)).alias("g")).select("rule", "n_true", "g.*")
    f = F.when((F.col("n") == 0) & (F.col("n_true") == 0), F.lit(1.0)).otherwise(
        5 * F.col("tp") / (5 * F.col("tp") + F.col("n_true") - F.col("tp") + 4 * (F.col("n") - F.col("tp")))
    )
    found = rows.groupBy("rule", "threshold").agg(((F.sum(f) + (n_entities - F.count("*"))) / n_entities).alias("macro_f05"))
    named = F.array(*[F.struct(F.lit(float(m)).alias("margin"), F.lit(float(q)).alias("penalty")) for m, q in rules])
    return found.select(F.get(named, F.col("rule")).alias("r"), "threshold", "macro_f05").select("r.*", "threshold", "macro_f05")


def best_rule(tuned: DataFrame) -> dict:
    """The rule with the largest macro F0.5; of equals the smallest margin, then the largest penalty, then the smallest threshold."""
    order = [F.desc("macro_f05"), F.col("margin"), F.desc("penalty"), F.col("threshold")]
    return tuned.orderBy(*order).first().asDict()


def apply_rule(edges: DataFrame, rule: dict, most: int = 11, wanted: DataFrame | None = None, left: str = "i1", right: str = "i23", p: str = "p") -> DataFrame:
    """The matches of a frozen rule: exclusive claims over all edges, then those of the wanted entities from the threshold on."""
    own = exclusive(edges, rule["margin"], rule["penalty"], left, right, p)
    if wanted is not None:
        own = own.join(wanted.select(left).distinct(), left, "left_semi")
    return threshold(own, rule["threshold"], most, left, right, p).select(left, right, p)


def prefix_values(
    edges: DataFrame, floor: float = 0.0, most: int = 8, missed: float = 0.0, left: str = "i1", right: str = "i23", p: str = "p"
) -> DataFrame:
    """(left, k, ef): the expected F0.5 of taking the first k edges of a list, for k from 0 on.

    Nothing is taken rightly if no edge is true, none that cannot be taken and
    none that blocking missed (``missed`` expected, as a Poisson number).
    """
    totals = edges.groupBy(left).agg(F.sum(p).alias("total"))
    kept = top(edges.where(F.col(p) >= floor), [left], [F.desc(p), F.col(right)], most)
    lists = kept.groupBy(left).agg(F.sort_array(F.collect_list(p), asc=False).alias("ps"))  # at most `most`
    rows = totals.join(lists, left, "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<double>")))
    zero = F.lit(0.0)
    taken = F.aggregate("ps", zero, lambda s, q: s + q)
    none = F.aggregate("ps", zero, lambda s, q: s + F.log1p(-F.least(q, F.lit(1 - 1e-9))))
    start = F.struct(
        F.array(F.lit(1.0)).alias("dist"), zero.alias("taken"), F.array(F.exp(none - (F.col("total") - taken) - missed)).alias("values")
    )

    def longer(state: Column, q: Column) -> Column:
        old, sum_ = state["dist"], state["taken"] + q
        grown = F.concat(old, F.array(zero))
        dist = F.transform(grown, lambda w, t: w * (1 - q) + F.when(t > 0, F.get(old, t - 1) * q).otherwise(zero))
        return F.struct(dist.alias("dist"), sum_.alias("taken"), state["values"].alias("values"))

    def valued(state: Column) -> Column:
        k = F.size(state["values"])
        unseen = F.greatest(F.col("total") - state["taken"], zero) + missed
        terms = F.transform(state["dist"], lambda w, t: F.when(t > 0, w * 5 * t / (5 * t + unseen + 4 * (k - t))).otherwise(zero))
        value = F.aggregate(terms, zero, lambda s, x: s + x)
        return F.struct(state["dist"].alias("dist"), state["taken"].alias("taken"), F.concat(state["values"], F.array(value)).alias("values"))

    found = F.aggregate("ps", start, lambda s, q: F.element_at(F.transform(F.array(longer(s, q)), valued), 1))["values"]
    return rows.select(left, F.posexplode(found).alias("k", "ef"))


POLICY = (
    "k", "ef_k", "ef_gap", "ef_best_k", "p_k", "p_next", "cum_p", "rest_p", "n_items", "p_null", "unc_mean", "unc_top", "cl_size_top",
    "comp_size", "p1", "p2", "gap12", "is_best_ef",
)


def policy_features(
    edges: DataFrame, most: int = 8, missed: float = 0.0, known: DataFrame | None = None, left: str = "i1", right: str = "i23", p: str = "p"
) -> DataFrame:
    """(left, the features of POLICY) of every list length; ``known``: (left, p_null, unc_mean, ...), 0 where absent."""
    values = prefix_values(edges, 0.0, most, missed, left, right, p)
    best = values.groupBy(left).agg(F.max("ef").alias("__best"), F.max_by("k", F.struct("ef", -F.col("k"))).alias("ef_best_k"))
    ranked = top(edges.where(F.col(p) >= 0), [left], [F.desc(p), F.col(right)], most)
    lists = ranked.groupBy(left).agg(F.sort_array(F.collect_list(p), asc=False).alias("ps"))  # at most `most`
    sums = edges.groupBy(left).agg(F.sum(p).alias("__total"))
    rows = values.join(best, left).join(lists, left).join(sums, left)
    at = lambda i: F.coalesce(F.get("ps", i), F.lit(0.0))
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns(
        {
            "ef_k": F.col("ef"),
            "ef_gap": F.col("__best") - F.col("ef"),
            "p_k": F.when(F.col("k") > 0, at(F.col("k") - 1)).otherwise(F.lit(1.0)),
            "p_next": at(F.col("k")),
            "cum_p": summed(F.slice("ps", 1, F.col("k"))),
            "rest_p": F.col("__total") - summed(F.col("ps")),
            "n_items": F.size(F.filter("ps", lambda x: x > 0)),
            "p1": at(F.lit(0)),
            "p2": at(F.lit(1)),
            "gap12": at(F.lit(0)) - at(F.lit(1)),
            "is_best_ef": (F.col("k") == F.col("ef_best_k")).cast("int"),
        }
    )
    extra = [c for c in ("p_null", "unc_mean", "unc_top", "cl_size_top", "comp_size")]
    if known is not None:
        rows = rows.join(known, left, "left")
    for c in extra:
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0))
    return rows.select(left, *POLICY)


def cheapest_length(costs: DataFrame, cost: str = "cost", left: str = "i1") -> DataFrame:
    """(left, k): the list length of the least (expected) cost, of equals the shorter one."""
    return costs.groupBy(left).agg(F.min_by("k", F.struct(F.col(cost), F.col("k"))).alias("k"))


def tune_lengths(
    edges: DataFrame, truth: DataFrame, entities: DataFrame, empty: Column | float = 0.5, floors: tuple = (0.05, 0.1, 0.2), lengths: tuple = (5, 8, 10),
    left: str = "i1", right: str = "i23", p: str = "p",
) -> DataFrame:
    """(floor, max_k, macro_f05) of expected-F selection by every floor and longest list."""
    from weft.operators import metrics

    report = None
    for floor in floors:
        for k in lengths:
            chosen = select_top(edges, expected_f(edges, floor, k, empty, 0.0, left, right, p), floor, left, right, p)
            one = metrics.macro(metrics.entity_scores(chosen, truth, entities, left, right)).select(
                F.lit(floor).alias("floor"), F.lit(k).alias("max_k"), "macro_f05"
            )
            report = one if report is None else report.unionByName(one)
    return report


def coalesced(rows: DataFrame, variants: list[str], out: str = "p") -> DataFrame:
    """The first score variant of a row that is not null: out-of-fold scores before the model's."""
    return rows.withColumn(out, F.coalesce(*variants))
