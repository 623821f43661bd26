"""More registered queries: studies, list policies, clusters, pools, the record parser and first-generation forms.

They add to the queries and SQL of ``catalog``, with the same conventions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as S
from weft.functions import text as X
from weft.operators import blocking, context, decide, dense, em, graph, mining, models, parse, studies
from weft.plans import catalog as C
from weft.plans.catalog import _EDGES, _EXCLUSIVE, _LEVELS, _LINKS, _RANKED, _TRUTH, _query, _r
from weft.sources import records as R

# Studies of the corpus.


def _orders(spark, sf) -> DataFrame:
    return R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("i23"), F.col("o_orderstatus").alias("src"), (F.col("o_custkey") % 25).alias("cty"))


@_query(f"""WITH {_TRUTH} SELECT o_orderstatus AS src, count(*) AS n, round(avg(CAST(o_orderkey NOT IN (SELECT i23 FROM truth) AS DOUBLE)), 6) AS unmatched FROM orders GROUP BY 1""")
def unmatched_share(spark, sf):
    return studies.unmatched_share(_orders(spark, sf), C._truth(spark, sf), "src").select("src", "n", _r("unmatched", "unmatched"))


@_query(f"""WITH {_TRUTH}, per AS (SELECT i1, o_orderstatus AS src, count(*) AS n FROM truth JOIN orders ON o_orderkey = i23 GROUP BY 1, 2)
SELECT src, round(avg(n), 6) AS mean_per, round(avg(CAST(n >= 2 AS DOUBLE)), 6) AS share_several, max(n) AS most FROM per GROUP BY 1""")
def source_repeats(spark, sf):
    rows = studies.repeats(C._truth(spark, sf), _orders(spark, sf), "src")
    return rows.select("src", _r("mean_per", "mean_per"), _r("share_several", "share_several"), "most")


@_query(f"""WITH {_TRUTH} SELECT count(*) AS n, round(avg(CAST(coalesce(s_nationkey = o_custkey % 25, FALSE) AS DOUBLE)), 6) AS agreement
FROM truth JOIN supplier ON s_suppkey = i1 JOIN orders ON o_orderkey = i23""")
def label_agreement(spark, sf):
    suppliers = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i1"), F.col("s_nationkey").alias("cty"))
    return studies.label_agreement(C._truth(spark, sf), suppliers, _orders(spark, sf)).select("n", _r("agreement", "agreement"))


@_query(f"""WITH {_TRUTH} SELECT 'ids' AS "check", round(corr(i1, i23), 6) AS correlation FROM truth
UNION ALL SELECT 'owner', round(corr(i1, o_custkey), 6) FROM truth JOIN orders ON o_orderkey = i23""")
def leakage_check(spark, sf):
    owners = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("i23"), "o_custkey")
    rows = studies.leakage(C._truth(spark, sf).join(owners, "i23"), {"ids": ("i1", "i23"), "owner": ("i1", "o_custkey")})
    return rows.select("check", _r("correlation", "correlation"))


@_query("""SELECT o_custkey % 25 AS cty, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P,
round((count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderstatus = 'P')) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0), 6) AS per_own FROM orders GROUP BY 1""")
def pool_density(spark, sf):
    rows = studies.density(_orders(spark, sf), "cty", "src", ["F", "O", "P"], "F")
    return rows.select("cty", "F", "O", "P", _r("per_own", "per_own"))


@_query("""WITH n AS (SELECT p_name AS v, count(*) AS k FROM part GROUP BY 1), z AS (SELECT p_size AS v, count(*) AS k FROM part GROUP BY 1)
SELECT p_brand AS cty, count(*) AS n, round(avg(CAST(n.k > 1 AS DOUBLE)), 6) AS share_name, round(avg(CAST(z.k > 1 AS DOUBLE)), 6) AS share_size
FROM part JOIN n ON n.v = p_name JOIN z ON z.v = p_size GROUP BY 1""")
def repeated_values(spark, sf):
    rows = studies.repeated_share(R.table(spark, sf, "part").withColumn("cty", F.col("p_brand")), "cty", {"name": F.lower("p_name"), "size": F.col("p_size")})
    return rows.select("cty", "n", _r("share_name", "share_name"), _r("share_size", "share_size"))


@_query(f"""WITH {_TRUTH}, per AS (SELECT s_nationkey AS cty, s_suppkey, count(i23) AS k FROM supplier LEFT JOIN truth ON i1 = s_suppkey GROUP BY 1, 2)
SELECT cty, count(*) AS n, round(avg(CAST(k = 0 AS DOUBLE)), 6) AS share_single, round(avg(k), 6) AS mean_k, round(median(k), 6) AS median_k,
round(quantile_cont(k, 0.99), 6) AS p99_k, bool_or(k > 0) AS any_match, bool_and(k > 0) AS all_match FROM per GROUP BY 1""")
def matches_by_label(spark, sf):
    suppliers = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i1"), F.col("s_nationkey").alias("cty"))
    rows = studies.matches_by_label(suppliers, C._truth(spark, sf))
    return rows.select("cty", "n", *[_r(c, c) for c in ("share_single", "mean_k", "median_k", "p99_k")], "any_match", "all_match")


@_query()
def density_sample(spark, sf):
    """A fifth of the suppliers by hash with their orders, and a fifth of the orders that nobody owns: a sampling operator."""
    suppliers = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i1"))
    own, records, pairs = studies.density_sample(suppliers, _orders(spark, sf).select("i23"), C._truth(spark, sf), 0.0, 0.2)
    parts = [own.select(F.lit("entity").alias("kind"), F.col("i1").alias("id")), records.select(F.lit("record").alias("kind"), F.col("i23").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(pairs.select(F.lit("pair").alias("kind"), F.col("i23").alias("id")))


# Lists and policies.


def _listed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of entities with a key and at least one edge that can be listed, as in the SQL."""
    return rows.join(edges.where("p >= 0").select("i1").distinct(), "i1", "left_semi")


@_query(f"""WITH RECURSIVE {C._prefix_sql(0.0, 8)}, z AS (SELECT i1, 0 AS k, exp(coalesce(list_sum(list_transform(ps, lambda q: ln(1 - least(q, 1 - 1e-9)))), 0) - (total - list_sum(ps))) AS v FROM l)
SELECT i1, CAST(k AS INTEGER) AS k, round(v, 6) AS ef FROM (SELECT * FROM v UNION ALL SELECT * FROM z)""")
def prefix_values(spark, sf):
    edges = C._order_edges(spark, sf)
    return _listed(decide.prefix_values(edges), edges).select("i1", "k", R.rounded(F.col("ef")).alias("ef"))


@_query(f"""WITH RECURSIVE {C._prefix_sql(0.0, 8)}, z AS (SELECT i1, 0 AS k, exp(coalesce(list_sum(list_transform(ps, lambda q: ln(1 - least(q, 1 - 1e-9)))), 0) - (total - list_sum(ps))) AS v FROM l),
a AS (SELECT * FROM v UNION ALL SELECT * FROM z), m AS (SELECT i1, max(v) AS best, arg_min(k, (-v, k)) AS best_k FROM a GROUP BY 1)
SELECT i1, CAST(k AS INTEGER) AS k, round(v, 5) AS ef_k, round(best - v, 5) AS ef_gap, CASE WHEN k > 0 THEN ps[k] ELSE 1 END AS p_k, coalesce(ps[k + 1], 0) AS p_next,
round(coalesce(list_sum(ps[1:k]), 0), 6) AS cum_p, round(total - list_sum(ps), 6) AS rest_p, CAST(len(list_filter(ps, lambda x: x > 0)) AS INTEGER) AS n_items,
ps[1] AS p1, coalesce(ps[2], 0) AS p2, round(ps[1] - coalesce(ps[2], 0), 6) AS gap12 FROM a JOIN m USING (i1) JOIN l USING (i1)""")
def policy_features(spark, sf):
    edges = C._order_edges(spark, sf)
    rows = _listed(decide.policy_features(edges), edges)
    rounded = [R.rounded(F.col(c), 5).alias(c) for c in ("ef_k", "ef_gap")] + [R.rounded(F.col(c)).alias(c) for c in ("cum_p", "rest_p", "gap12")]
    return rows.select("i1", "k", *rounded, "p_k", "p_next", "n_items", "p1", "p2")


@_query(f"""WITH {_EDGES}, {_RANKED}, {_TRUTH}, h AS (SELECT r.i1, r.r, count(t.i1) OVER (PARTITION BY r.i1 ORDER BY r.r) AS tp FROM ranked r LEFT JOIN truth t ON t.i1 = r.i1 AND t.i23 = r.i23 WHERE r.r <= 8),
n AS (SELECT i1, count(*) AS nt FROM truth GROUP BY 1), a AS (SELECT i1, CAST(r AS INTEGER) AS k, tp FROM h UNION ALL SELECT DISTINCT i1, 0, 0 FROM edges),
c AS (SELECT a.i1, a.k, 1 - CASE WHEN a.k = 0 AND coalesce(nt, 0) = 0 THEN 1 ELSE 5 * tp / (5 * tp + coalesce(nt, 0) - tp + 4 * (a.k - tp)) END AS cost FROM a LEFT JOIN n USING (i1))
SELECT i1, arg_min(k, (cost, k)) AS k FROM c GROUP BY 1""")
def policy_choice(spark, sf):
    """The list length of the least cost: what a policy model is taught, and how its predictions are turned into lists."""
    return decide.cheapest_length(decide.cost_table(R.scored_edges(spark, sf), C._truth(spark, sf)))


@_query(f"""WITH {_EDGES}, {_EXCLUSIVE} SELECT i1, i23, round(p, 6) AS p FROM own WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY i1 ORDER BY p DESC, i23) <= 11""")
def frozen_rule(spark, sf):
    found = decide.apply_rule(R.scored_edges(spark, sf), {"margin": 0.1, "penalty": 0.9, "threshold": 0.5})
    return found.select("i1", "i23", _r("p", "p"))


@_query()
def length_tuning(spark, sf):
    rows = decide.tune_lengths(C._order_edges(spark, sf), _order_truth(spark, sf), C._order_edges(spark, sf).select("i1").distinct(), 0.5, (0.1, 0.3), (2, 8))
    return rows.select("floor", "max_k", _r("macro_f05", "macro_f05"))


def _order_truth(spark, sf) -> DataFrame:
    return R.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("i1"), F.col("o_orderkey").alias("i23"))


@_query(f"""WITH {_EDGES}, e AS (SELECT i1, i23, CASE WHEN i23 % 3 = 0 THEN NULL ELSE round(1 - p, 6) END AS p_oof, p FROM edges) SELECT i1, i23, coalesce(p_oof, p) AS p FROM e""")
def score_coalesce(spark, sf):
    edges = R.scored_edges(spark, sf).withColumn("p_oof", F.when(F.col("i23") % 3 != 0, F.round(1 - F.col("p"), 6)))
    return decide.coalesced(edges, ["p_oof", "p"]).select("i1", "i23", "p")


@_query(f"""WITH {_EDGES}, a AS (SELECT i1, i23, [p, p * p, 1 - p]::DOUBLE[] AS s FROM edges)
SELECT i1, i23, round(list_avg(s), 6) AS unc_mean, round(list_stddev_pop(s), 5) AS unc_std, list_min(s) AS unc_min, list_max(s) AS unc_max,
CAST(len(list_filter(s, lambda x: x > 0.5)) AS INTEGER) AS unc_votes FROM a""")
def score_spread(spark, sf):
    edges = R.scored_edges(spark, sf).withColumn("q", F.col("p") * F.col("p")).withColumn("o", 1 - F.col("p"))
    rows = context.score_spread(edges, ["p", "q", "o"])
    return rows.select("i1", "i23", _r("unc_mean", "unc_mean"), F.round("unc_std", 5).alias("unc_std"), "unc_min", "unc_max", "unc_votes")


@_query(f"WITH {_EDGES}, {_RANKED} SELECT i1, i23, p FROM ranked WHERE r <= 5 OR p >= 0.9")
def pruned_lists(spark, sf):
    return studies.prune(R.scored_edges(spark, sf), "p", 5, 0.9)


@_query(f"""WITH {_EDGES}, {_RANKED}, st AS (SELECT i1, i23 AS mate, p AS m_p, r FROM ranked WHERE p >= 0.5 AND r <= 2), k AS (SELECT i1, count(*) AS m_n_strong FROM edges WHERE p >= 0.5 GROUP BY 1),
f AS (SELECT e.i1, e.i23, mate, m_p FROM edges e JOIN st ON st.i1 = e.i1 AND st.mate <> e.i23 WHERE e.p BETWEEN 0.003 AND 0.997
QUALIFY row_number() OVER (PARTITION BY e.i1, e.i23 ORDER BY st.r) = 1) SELECT i1, i23, mate, m_p, m_n_strong FROM f JOIN k USING (i1)""")
def mate_pairs(spark, sf):
    return context.mates(R.scored_edges(spark, sf))


@_query(f"""WITH {_EDGES}, {_EXCLUSIVE}, x AS (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY p DESC, i23) AS r FROM own),
s AS (SELECT i1, max(p) FILTER (r = 1) AS t1, max(p) FILTER (r = 2) AS t2, max(p) FILTER (r = 3) AS t3, sum(p) AS psum, count(*) FILTER (p >= 0.5) AS n05, count(*) FILTER (p >= 0.8) AS n08 FROM x GROUP BY 1),
b AS (SELECT l_suppkey AS i1, count(DISTINCT l_orderkey) AS ncand, max(l_quantity) AS blk_max FROM lineitem GROUP BY 1),
q AS (SELECT l_suppkey AS i1, l_orderkey, count(*) AS n_passes FROM lineitem GROUP BY 1, 2), n AS (SELECT i1, max(n_passes) AS npass_max FROM q GROUP BY 1)
SELECT s_suppkey AS i1, round(coalesce(t1, 0), 6) AS t1, round(coalesce(t2, 0), 6) AS t2, round(coalesce(t3, 0), 6) AS t3, round(coalesce(psum, 0), 3) AS psum, coalesce(n05, 0)::DOUBLE AS n05,
coalesce(n08, 0)::DOUBLE AS n08, coalesce(ncand, 0)::DOUBLE AS ncand, coalesce(blk_max, 0)::DOUBLE AS blk_max, coalesce(npass_max, 0)::DOUBLE AS npass_max,
s_acctbal AS idf_sum, length(s_name)::DOUBLE AS a_len, (s_nationkey % 2)::DOUBLE AS has_house
FROM supplier LEFT JOIN s ON s.i1 = s_suppkey LEFT JOIN b ON b.i1 = s_suppkey LEFT JOIN n ON n.i1 = s_suppkey""")
def single_features(spark, sf):
    own = decide.exclusive(R.scored_edges(spark, sf), 0.1, 0.9)
    entities = R.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("i1"), *[F.lit(0.0).alias(c) for c in ("f_core_s1_r", "f_core_s23_r", "f_addr_s1_r")],
        F.col("s_acctbal").alias("idf_sum"), F.length("s_name").alias("a_len"), (F.col("s_nationkey") % 2).alias("has_house"),
    )
    candidates = R.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i1"), F.col("l_orderkey").alias("i23")).agg(
        F.max("l_quantity").alias("blk"), F.count("*").alias("n_passes")
    )
    rows = context.single_features(entities, own, candidates)
    kept = ("n05", "n08", "ncand", "blk_max", "npass_max", "idf_sum", "a_len", "has_house")
    return rows.select("i1", _r("t1", "t1"), _r("t2", "t2"), _r("t3", "t3"), F.round("psum", 3).alias("psum"), *kept)


@_query(f"""WITH {_EDGES}, {_RANKED}, {_LINKS}, {_TRUTH}, p AS (SELECT DISTINCT x, y FROM links)
SELECT x, y, CAST(EXISTS (SELECT 1 FROM truth a JOIN truth b USING (i1) WHERE a.i23 = x AND b.i23 = y) AS INTEGER) AS same FROM p""")
def companion_labels(spark, sf):
    return studies.companion_labels(C._links(spark, sf).select("x", "y").distinct(), C._truth(spark, sf)).select("x", "y", "same")


# Clusters.

_FEATURE_EDGES = """fe AS (SELECT l_suppkey AS i1, l_orderkey AS i23, round(max(l_extendedprice) / 105000, 6) AS p, max(l_quantity) AS h, max(l_discount) AS po, max(l_tax) AS nu,
min(l_quantity) AS nm, min(l_discount) AS ad, min(l_tax) AS dc FROM lineitem GROUP BY 1, 2)"""


@_query(f"""WITH RECURSIVE {_EDGES}, {_RANKED}, {_LINKS}, {_FEATURE_EDGES}, l9 AS (SELECT x, y FROM links WHERE p_link >= 0.9999), {C._closed(9, "l9")},
g AS (SELECT fe.*, coalesce(comp, i23) AS cl, coalesce(n, 1) AS cl_size FROM fe LEFT JOIN c9 ON node = i23 LEFT JOIN n9 USING (comp)),
w AS (SELECT *, count(*) OVER c AS n_in, sum(i23 % 2) OVER c AS s3, max(p) OVER c AS pmax, avg(p) OVER c AS pmean, stddev_samp(p) OVER c AS pstd,
nth_value(p, 2) OVER (PARTITION BY i1, cl ORDER BY p DESC, i23 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p2,
max(h) OVER c AS bh, max(po) OVER c AS bpo, max(nu) OVER c AS bnu, max(nm) OVER c AS bnm, max(ad) OVER c AS bad, max(dc) OVER c AS bdc FROM g WINDOW c AS (PARTITION BY i1, cl)),
b AS (SELECT i1, x AS i23, y AS m, p_link FROM links WHERE p_link >= 0.999 UNION ALL SELECT i1, y, x, p_link FROM links WHERE p_link >= 0.999),
i AS (SELECT b.i1, b.i23, max(p_link * e.p) AS inh, count(*) AS soft_n, max(p_link) AS lmax FROM b JOIN edges e ON e.i1 = b.i1 AND e.i23 = b.m GROUP BY 1, 2)
SELECT i1, i23, cl_size, n_in AS cl_in_list, CAST(s3 > 0 AND s3 < n_in AS INTEGER) AS cl_src_mix, CASE WHEN n_in <= 1 THEN -1 WHEN p >= pmax THEN p2 ELSE pmax END AS cl_p_max_other,
round(pmean, 6) AS cl_p_mean, round(coalesce(pstd, 0), 6) AS cl_p_std, bh AS cl_best_house, bpo AS cl_best_postal, bnu AS cl_best_num, bnm AS cl_best_name, bad AS cl_best_addr, bdc AS cl_best_dcos,
round(coalesce(inh, 0), 6) AS cl_inherit, coalesce(soft_n, 0) AS cl_soft_n, coalesce(lmax, 0) AS cl_link_max FROM w LEFT JOIN i USING (i1, i23)""")
def cluster_family(spark, sf):
    lines = R.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i1"), F.col("l_orderkey").alias("i23"))
    edges = lines.agg(
        F.round(F.max("l_extendedprice") / 105000, 6).alias("p"), F.max("l_quantity").alias("h"), F.max("l_discount").alias("po"), F.max("l_tax").alias("nu"),
        F.min("l_quantity").alias("nm"), F.min("l_discount").alias("ad"), F.min("l_tax").alias("dc"),
    )
    links = C._links(spark, sf)
    clustered = graph.components(links.where("p_link >= 0.9999"), "x", "y")
    best = {"house": "h", "postal": "po", "num": "nu", "name": "nm", "addr": "ad", "dcos": "dc"}
    rows = graph.cluster_family(edges, clustered, links, best, F.col("i23") % 2 == 1, 0.999)
    rounded = ("cl_p_mean", "cl_p_std", "cl_inherit")
    return rows.select(*[_r(c, c) if c in rounded else F.col(c) for c in rows.columns])


# Blocking in full.


@_query(f"""WITH {_EDGES}, {_TRUTH}, {_RANKED}, c AS (SELECT i1, i23 FROM ranked WHERE r <= 50), s AS (SELECT i1, count(*) AS n FROM c GROUP BY 1),
per AS (SELECT s_suppkey AS i1, count(t.i23) AS nt, count(c.i23) AS tp FROM supplier LEFT JOIN truth t ON t.i1 = s_suppkey LEFT JOIN c ON c.i1 = t.i1 AND c.i23 = t.i23 GROUP BY 1)
SELECT round((SELECT sum(n) FROM s) / count(*), 6) AS mean, (SELECT quantile_cont(n, 0.95) FROM s) AS p95, (SELECT max(n) FROM s) AS longest,
round(avg(CAST(tp = nt AS DOUBLE)) FILTER (nt > 0), 6) AS ceiling, round(avg(CASE WHEN nt = 0 THEN 1 ELSE 5 * tp / (4 * tp + nt) END), 6) AS oracle_f05 FROM per""")
def blocking_lists(spark, sf):
    found = blocking.top(R.scored_edges(spark, sf), ["i1"], [F.desc("p"), F.col("i23")], 50)
    rows = blocking.list_report(found, C._truth(spark, sf), C._entities(spark, sf))
    return rows.select(_r("mean", "mean"), "p95", "longest", _r("ceiling", "ceiling"), _r("oracle_f05", "oracle_f05"))


@_query(f"""WITH {C._PASSES}, {_TRUTH}, m AS (SELECT CAST(pa.i1 IS NOT NULL AS INTEGER) AS a, CAST(pb.i1 IS NOT NULL AS INTEGER) AS b FROM truth t
LEFT JOIN pa ON pa.i1 = t.i1 AND pa.i23 = t.i23 LEFT JOIN pb ON pb.i1 = t.i1 AND pb.i23 = t.i23)
SELECT 'p2' AS pass, round(avg(a), 6) AS recall_alone, round(avg(CAST(a = 1 AND b = 0 AS DOUBLE)), 6) AS only_by_this FROM m
UNION ALL SELECT 'p5', round(avg(b), 6), round(avg(CAST(b = 1 AND a = 0 AS DOUBLE)), 6) FROM m""")
def blocking_pass_recall(spark, sf):
    found = C._passes(spark, sf)
    rows = blocking.pass_report(found, C._truth(spark, sf), {p: F.col(f"found_{p}") for p in ("p2", "p5")})
    return rows.select("pass", _r("recall_alone", "recall_alone"), _r("only_by_this", "only_by_this"))


@_query(f"""WITH {_EDGES}, {_RANKED}, x AS (SELECT i1, i23, 2 AS n_passes, 1 AS p6 FROM ranked WHERE r <= 50), q AS (SELECT l_suppkey AS i1, l_orderkey AS i23, sum(l_quantity) AS dcos FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY dcos DESC, i23) AS drank, row_number() OVER (PARTITION BY i23 ORDER BY dcos DESC, i1) AS rr FROM q),
e AS (SELECT i1, i23, dcos, CASE WHEN drank <= 20 THEN drank END AS drank, CASE WHEN rr <= 1 THEN rr END AS drev_rank FROM d WHERE drank <= 20 OR rr <= 1),
f AS (SELECT i1, i23, n_passes, p6, dcos, drank, drev_rank, CAST(x.i1 IS NOT NULL AS INTEGER) AS in_lexical FROM x FULL JOIN e USING (i1, i23))
SELECT i1, i23, CASE WHEN in_lexical = 0 THEN 0 ELSE n_passes END AS n_passes, CASE WHEN in_lexical = 0 THEN 0 ELSE p6 END AS p6, in_lexical, coalesce(dcos, -1) AS dcos,
CAST(coalesce(drank, 21) AS INTEGER) AS drank, CAST(coalesce(drev_rank, 9) AS INTEGER) AS drev_rank, count(*) OVER (PARTITION BY i1) AS n_cand
FROM (SELECT i1, i23, n_passes, p6, dcos, drank, drev_rank, CASE WHEN n_passes IS NULL THEN 0 ELSE 1 END AS in_lexical FROM f)""")
def dense_pool(spark, sf):
    lexical = blocking.top(R.scored_edges(spark, sf), ["i1"], [F.desc("p"), F.col("i23")], 50).select("i1", "i23", F.lit(2).alias("n_passes"), F.lit(1).alias("p6"))
    lines = R.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i1"), F.col("l_orderkey").alias("i23")).agg(F.sum("l_quantity").alias("dcos"))
    found = dense.forward_reverse(lines.withColumn("cty", F.lit("all")), 20, 1).drop("cty")
    return dense.filled(dense.pool(lexical, found)).select("i1", "i23", "n_passes", "p6", "in_lexical", "dcos", "drank", "drev_rank", "n_cand")


# The record parser on composed records, and first-generation forms.

_COMPOSED = """q AS (SELECT p_partkey AS id, p_size AS z, p_partkey % 900 + 1 AS n, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b,
CAST(100000 + p_partkey * 7 % 900000 AS VARCHAR) AS postal FROM part)"""


def _composed(spark, sf) -> DataFrame:
    """Part names and numbers written as business records."""
    a, b = F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))
    code = (100000 + F.col("p_partkey") * 7 % 900000).cast("string")
    return R.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.lit("x").alias("cty"),
        F.concat(F.lit("Dr "), a, F.lit(" of "), F.upper(b), F.lit(" Ltd d/b/a "), b, F.lit(" Traders")).alias("business_name"),
        F.concat(
            F.lit("Unit "), F.col("p_size").cast("string"), F.lit(", 00"), (F.col("p_partkey") % 900 + 1).cast("string"), F.lit(" "), F.initcap(a), F.lit(" Street, Near "), b,
            F.lit(" School, P.O. Box 7, "), b, F.lit(" Nagar Pin: "), F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 3),
        ).alias("business_address"),
    )


@_query(f"""WITH {_COMPOSED} SELECT id, a || ' of ' || b || ' ltd' AS name_n, a || ' ' || b AS core, b || ' trader' AS trade, 'ltd' AS legal, a[1] || b[1] AS acr, '' AS url,
array_to_string(list_sort([a, b]), ' ') AS k_sorted, a || b AS k_joined, '' AS name_nums, FALSE AS native, TRUE AS has_dba FROM q""")
def composed_names(spark, sf):
    rows = parse.parse_records(_composed(spark, sf))
    lists = [F.array_join(c, " ").alias(c) for c in ("core", "trade", "name_nums")]
    return rows.select("id", "name_n", *lists, "legal", "acr", "url", "k_sorted", "k_joined", "native", "has_dba")


@_query(f"""WITH {_COMPOSED} SELECT id, 'unit ' || z || ' ' || n || ' ' || a || ' st ' || b || ' nagar pin' AS addr_n, n || ' ' || a || ' st ' || b || ' nagar pin' AS a_toks,
CASE WHEN n = z THEN '' ELSE a || ' st' END AS street, CASE WHEN n = z THEN '' ELSE CAST(n AS VARCHAR) END AS house, CAST(z AS VARCHAR) AS unit, postal,
b || ' nagar pin' AS segs, b || ' school' AS landmark, CAST(n AS VARCHAR) AS numset FROM q""")
def composed_addresses(spark, sf):
    rows = parse.parse_records(_composed(spark, sf))
    lists = [F.array_join(c, " ").alias(c) for c in ("a_toks", "street", "segs", "numset")]
    return rows.select("id", "addr_n", *lists, "house", "unit", "postal", "landmark")


_FIRST = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in X.FIRST_FORMS.items()) + "}"


@_query(f"""WITH t AS (SELECT p_partkey AS id, 'The ' || p_name || ' Company''s, ' || p_size || ' ' || p_type || ' Street & Services' AS s FROM part),
w AS (SELECT id, list_filter(string_split(regexp_replace(replace(lower(s), '''', ''), '[^a-z0-9&]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM t)
SELECT id, array_to_string(list_transform(ws, lambda x: coalesce({_FIRST}[x], x)), ' ') AS norm FROM w""")
def first_norm(spark, sf):
    text = F.concat(F.lit("The "), "p_name", F.lit(" Company's, "), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.lit(" Street & Services"))
    return R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.first_norm(text).alias("norm"))


@_query(f"""WITH {C._NAME_PAIRS}, w AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pairs)
SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS addr_jacc, -1.0::DOUBLE AS num_jacc, round(jaro_winkler_similarity(a, b), 5) AS name_jw,
CAST(length(a) AS INTEGER) AS len_a, CAST(length(b) AS INTEGER) AS len_b FROM w""")
def first_features(spark, sf):
    pairs = C._name_pairs(spark, sf)
    rows = S.first_features(pairs, "a", "b", "a", "b")
    return rows.select("a", "b", _r("addr_jacc", "addr_jacc"), "num_jacc", F.round("name_jw", 5).alias("name_jw"), "len_a", "len_b")


@_query()
def mining_tables(spark, sf):
    """Word forms mined from part names and their noisy spellings against names of other parts."""
    names = C._names(spark, sf).select(F.lit("x").alias("cty"), F.col("name"), F.split("name", " ").alias("a"))
    noisy = names.withColumn("b", F.transform("a", lambda t: F.concat(t, F.substring(t, -1, 1))))
    others = C._name_pairs(spark, sf).select(F.lit("x").alias("cty"), F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return mining.tables(noisy.select("cty", "a", "b"), others, "a", "b")


# Weights by label and out of fold, reports of models.


def _em_by(condition: str) -> str:
    """Expectation maximisation of every part of the pairs: over the parts that the condition joins to a group."""
    whole = C._em_sql()
    fields = ", ".join(_LEVELS)
    head, rest = whole.split("t AS (SELECT", 1)
    rest = rest.split("),\nst AS (", 1)[1]
    grouped = rest.replace("SELECT 0 AS r,", "SELECT grp, 0 AS r,").replace("FROM lv\nUNION", "FROM lv, (SELECT DISTINCT grp FROM t) GROUP BY grp\nUNION")
    grouped = grouped.replace("UNION ALL SELECT r + 1,", "UNION ALL SELECT grp, r + 1,").replace("FROM (SELECT r, ll,", "FROM (SELECT grp, r, ll,")
    grouped = grouped.replace("FROM st, t WHERE", "FROM st JOIN t USING (grp) WHERE").replace("GROUP BY r, ll)", "GROUP BY grp, r, ll)")
    grouped = grouped.replace("ORDER BY r DESC LIMIT 1", "QUALIFY row_number() OVER (PARTITION BY grp ORDER BY r DESC) = 1")
    grouped = grouped.replace("FROM t, last)", "FROM own JOIN last USING (grp))").replace(f"w AS (SELECT {fields}, n, prior", f"w AS (SELECT grp, {fields}, n, prior")
    grouped = grouped.replace(f"\nSELECT {fields}, n,", f"\nSELECT grp, {fields}, n,")
    return (
        head
        + f"pt AS (SELECT *, i1 % 3 AS part FROM lv), own AS (SELECT part AS grp, {fields}, count(*) AS n FROM pt GROUP BY ALL), "
        + f"t AS (SELECT g.grp, {fields}, count(*) AS n FROM pt JOIN (SELECT DISTINCT part AS grp FROM pt) g ON {condition} GROUP BY ALL),\nst AS ("
        + grouped
    )


def _parted_levels(spark, sf) -> DataFrame:
    lines = R.table(spark, sf, "lineitem")
    return C._level_rows(spark, sf, lines.withColumn("grp", F.col("l_suppkey") % 3), "grp")


def _em_rows(spark, sf, fit) -> DataFrame:
    rows = _parted_levels(spark, sf)
    weights = fit(rows, _LEVELS, em.supervised(rows, _LEVELS), "grp")
    scored = em.scored_by(rows.groupBy("grp", *_LEVELS).agg(F.count("*").alias("n")), weights, "grp")
    return scored.select("grp", *_LEVELS, "n", *[F.round(c, 5).alias(c) for c in [*[f"w_{f}" for f in _LEVELS], "weight", "posterior"]])


@_query(_em_by("pt.part = g.grp"))
def weights_em_by_label(spark, sf):
    return _em_rows(spark, sf, em.fit_by)


@_query(_em_by("pt.part <> g.grp"))
def weights_em_out_of_fold(spark, sf):
    return _em_rows(spark, sf, em.fit_without)


def _by_region(spark, sf) -> DataFrame:
    nations = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i1"), (F.col("s_nationkey") % 5).cast("string").alias("cty"))
    # broadcast by their number: each pass over the rows would shuffle them otherwise
    if nations.count() <= C._BROADCAST:
        nations = F.broadcast(nations)
    return C._feature_rows(spark, sf).join(nations, "i1")


@_query()
def leave_one_out_report(spark, sf):
    rows = _by_region(spark, sf)
    fit = lambda kept, groups: models.scorers_without(kept, groups, "cty", C._FEATURES)
    report = studies.leave_one_out_together(rows, list("01234"), "cty", fit, lambda own: models.auc(own, "p_loo", by=("cty",)))
    return report.select("cty", _r("auc", "auc"))


@_query()
def ablation_report(spark, sf):
    families = {"score": ["p", "p_gap"], "lists": ["n_cand", "rev_n", "p_rev_gap"]}
    report = studies.ablation(C._feature_rows(spark, sf), families, models.scorer, lambda rows: models.auc(rows, "p_abl"))
    return report.select("without", _r("auc", "auc"))

