"""Comparison vectors of record pairs: native columns, with Arrow kernels for what Spark cannot say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as S
from weft.operators.graph import saved

#: Fields of a parsed and enriched record that a comparison reads.
NEEDED = (
    "name_n", "core", "trade", "legal", "acr", "url", "k_sorted", "k_joined", "k_skel", "k_trans", "k_meta", "name_nums",
    "native", "has_dba", "addr_n", "a_toks", "street", "house", "unit", "postal", "region", "loc", "landmark", "numset",
    "core_idf", "a_idf", "f_core_s1", "f_core_s23", "f_addr_s1", "f_addr_s23",
    "f_core_s1_r", "f_core_s23_r", "f_addr_s1_r", "f_addr_s23_r",
)

#: Members of a class in one row, about, at most.
CLASS_ROWS = 10_000


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _weights(words: Column, idf: Column) -> Column:
    """map<word, idf> with one entry a word."""
    pairs = F.arrays_zip(words.alias("w"), idf.alias("i"))
    firsts = F.filter(pairs, lambda x, at: F.array_position(words, x["w"]) == at + 1)
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["w"], x["i"])))


def compare(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "i1", right_id: str = "i23") -> DataFrame:
    """The pairs with the features of their two records; kernels run once a distinct pair of texts in a batch.

    ``left`` and ``right`` hold the ids and the fields in ``NEEDED``.
    """
    a = left.select(left_id, F.struct(*NEEDED).alias("a"))
    b = right.select(right_id, F.struct(*NEEDED).alias("b"))
    return compared(pairs.join(a, left_id).join(b, right_id))


def compare_groups(records: DataFrame, key: str, by: list[str], left_id: str = "i1", right_id: str = "i23") -> DataFrame:
    """All pairs (left_id < right_id) of records that agree in ``by``, with the features of ``compare``.

    Records of a group with equal fields are one class. Features are made once
    for two classes, and their members' pairs are listed from that row on the
    way out, so nothing that grows with the pairs is shuffled or stored.
    """
    fields = records.select(*by, key, F.struct(*NEEDED).alias("__f"))
    sizes = records.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1")
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / CLASS_ROWS)).alias("__part")
    classes = saved(fields.join(sizes, by).groupBy(*by, "__f", part).agg(F.array_sort(F.collect_list(key)).alias("__ids")))
    # the classes are few, their pairs are not: tasks are not merged by the size of what they read
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (classes.select(*by, F.col("__f").alias(c), F.col("__ids").alias(f"__{c}")).repartition(tasks, *by) for c in "ab")
    met = a.join(b.hint("merge"), by).where(F.get("__a", F.lit(0)) < F.try_element_at("__b", F.lit(-1))).drop(*by)
    rows = compared(met)
    features = [c for c in rows.columns if c not in ("__a", "__b")]
    rows = rows.select("*", F.explode("__a").alias(left_id)).drop("__a")
    later = F.filter("__b", lambda x: x > F.col(left_id))
    return rows.select("*", F.explode(later).alias(right_id)).select(right_id, left_id, *features)


def compared(joined: DataFrame) -> DataFrame:
    """The rows with the features of their records ``a`` and ``b``, structs of the fields in ``NEEDED``, in place of these."""

    def both(field: str) -> tuple[Column, Column]:
        return F.col("a")[field], F.col("b")[field]

    (nn_a, nn_b), (core_a, core_b), (kj_a, kj_b) = both("name_n"), both("core"), both("k_joined")
    (ad_a, ad_b), (at_a, at_b), (ho_a, ho_b), (lm_a, lm_b) = both("addr_n"), both("a_toks"), both("house"), both("landmark")
    (url_a, url_b), (nu_a, nu_b), (tr_a, tr_b), (lo_a, lo_b) = both("url"), both("name_nums"), both("trade"), both("loc")
    cs_a, cs_b = F.array_join(core_a, " "), F.array_join(core_b, " ")
    ts_a, ts_b = F.array_join(tr_a, " "), F.array_join(tr_b, " ")
    bare_a, bare_b = F.replace(ad_a, F.lit(" "), F.lit("")), F.replace(ad_b, F.lit(" "), F.lit(""))
    empty = (ad_a == "") | (ad_b == "")

    def kernel(k, x: Column, y: Column) -> Column:
        return S.of_columns(k, x, y)

    def known(value: Column, missing: Column = empty) -> Column:
        return F.when(missing, F.lit(S.UNKNOWN)).otherwise(value)

    def ratio_of(x: Column, y: Column) -> Column:
        return F.least(x, y) / F.greatest(x, y, F.lit(1))

    n_over, n_top = S.weighted_overlap(_weights(core_a, F.col("a")["core_idf"]), _weights(core_b, F.col("b")["core_idf"]))
    a_over, _ = S.weighted_overlap(_weights(at_a, F.col("a")["a_idf"]), _weights(at_b, F.col("b")["a_idf"]))
    missing = [
        _flag(r["house"] == "") + _flag(F.size(r["street"]) == 0) + _flag(r["region"] == "") + _flag(F.size(r["loc"]) == 0)
        for r in (F.col("a"), F.col("b"))
    ]
    named = F.greatest(
        kernel(S.set_ratio, cs_a, cs_b),
        F.when(ts_a != "", kernel(S.set_ratio, ts_a, cs_b)),
        F.when(ts_b != "", kernel(S.set_ratio, cs_a, ts_b)),
        F.when((ts_a != "") & (ts_b != ""), kernel(S.set_ratio, ts_a, ts_b)),
    )
    site = (url_a != "") | (url_b != "")
    same_site = ((url_a != "") & ((url_a == kj_b) | (url_a == url_b))) | ((url_b != "") & (url_b == kj_a))
    numbers = F.when((F.size(nu_a) == 0) & (F.size(nu_b) == 0), -1.0).when(nu_a == nu_b, 1.0).when(F.arrays_overlap(nu_a, nu_b), 0.5).otherwise(0.0)
    near = (lm_a != "") | (lm_b != "")
    near_name = ((lm_a != "") & (kj_b != "") & F.replace(lm_a, F.lit(" "), F.lit("")).contains(kj_b)) | (
        (lm_b != "") & (kj_a != "") & F.replace(lm_b, F.lit(" "), F.lit("")).contains(kj_a)
    )
    digits = [F.regexp_replace(h, "[^0-9]", "") for h in (ho_a, ho_b)]
    n_tset, a_tset = F.col("n_tset"), F.col("a_tset")
    features = {
        "n_ratio": kernel(S.ratio, nn_a, nn_b),
        "n_tset": kernel(S.set_ratio, cs_a, cs_b),
        "n_tsort": kernel(S.sorted_ratio, cs_a, cs_b),
        "n_partial": kernel(S.partial_ratio, cs_a, cs_b),
        "n_jw_full": kernel(S.jaro_winkler, nn_a, nn_b),
        "n_jw_core": kernel(S.jaro_winkler, kj_a, kj_b),
        "n_lev": S.edit_similarity(cs_a, cs_b),
        "n_lcs": kernel(S.subsequence_similarity, kj_a, kj_b),
        "n_c3": S.gram_cosine(kj_a, kj_b),
        "n_jacc": S.jaccard(F.array_distinct(core_a), F.array_distinct(core_b)),
        "n_soft": kernel(S.soft_jaccard, core_a, core_b),
        "n_monge": kernel(S.monge_elkan, core_a, core_b),
        "n_idf_ov": n_over,
        "n_idf_max": n_top,
        "n_first_eq": _flag(F.get(core_a, F.lit(0)) == F.get(core_b, F.lit(0))),
        "n_last_eq": _flag(F.try_element_at(core_a, F.lit(-1)) == F.try_element_at(core_b, F.lit(-1))),
        "n_dba_max": named,
        "n_len_ratio": ratio_of(F.length(nn_a), F.length(nn_b)),
        "n_tok_diff": F.abs(F.size(core_a) - F.size(core_b)).cast("double"),
        **{f"{k}_eq": _flag(both(k)[0] == both(k)[1]) for k in ("k_sorted", "k_joined", "k_skel", "k_trans")},
        "k_meta_eq": _flag((both("k_meta")[0] == both("k_meta")[1]) & (both("k_meta")[0] != "")),
        "n_acr": _flag((both("acr")[0] != "") & (both("acr")[0] == kj_b)) + _flag((both("acr")[1] != "") & (both("acr")[1] == kj_a)),
        "url_match": F.when(site, _flag(same_site)).otherwise(S.UNKNOWN),
        "url_jw": F.when(
            site,
            F.greatest(
                F.when(url_a != "", kernel(S.jaro_winkler, url_a, kj_b)).otherwise(0.0),
                F.when(url_b != "", kernel(S.jaro_winkler, url_b, kj_a)).otherwise(0.0),
            ),
        ).otherwise(S.UNKNOWN),
        "n_legal": S.agreement(*both("legal")),
        "n_nums": numbers,
        "a_postal": S.agreement(*both("postal")),
        "a_postal3": S.agreement(*(F.substring(x, 1, 3) for x in both("postal"))),
        "a_house": S.agreement(ho_a, ho_b),
        "a_house_num": S.agreement(*digits),
        "a_unit": S.agreement(*both("unit")),
        "a_region": S.agreement(*both("region")),
        "a_loc": known(F.arrays_overlap(lo_a, lo_b).cast("double"), (F.size(lo_a) == 0) | (F.size(lo_b) == 0)),
        "a_num_jacc": S.jaccard(*both("numset")),
        "a_street_jacc": S.jaccard(*(F.array_distinct(x) for x in both("street"))),
        "lm_a": _flag(lm_a != ""),
        "lm_b": _flag(lm_b != ""),
        "lm_sim": F.when((lm_a != "") & (lm_b != ""), kernel(S.set_ratio, lm_a, lm_b)).otherwise(S.UNKNOWN),
        "lm_name": F.when(near, _flag(near_name)).otherwise(S.UNKNOWN),
        "miss_a": missing[0],
        "miss_b": missing[1],
        "miss_diff": missing[0] - missing[1],
        "a_c3": known(S.gram_cosine(bare_a, bare_b)),
        "a_tset": known(kernel(S.set_ratio, ad_a, ad_b)),
        "a_ratio": known(kernel(S.ratio, ad_a, ad_b)),
        "a_partial": known(kernel(S.partial_ratio, ad_a, ad_b)),
        "a_idf_ov": known(a_over),
        "a_jacc": S.jaccard(F.array_distinct(at_a), F.array_distinct(at_b)),
        "a_len_ratio": known(ratio_of(F.length(ad_a), F.length(ad_b))),
        "a_empty_a": _flag(ad_a == ""),
        "a_empty_b": _flag(ad_b == ""),
        "x_name_in_addr_ab": known(kernel(S.partial_ratio, kj_a, bare_b), (ad_b == "") | (F.length(kj_a) < 4)),
        "x_name_in_addr_ba": known(kernel(S.partial_ratio, kj_b, bare_a), (ad_a == "") | (F.length(kj_b) < 4)),
        "x_swap": F.greatest(
            F.when(ad_b != "", kernel(S.set_ratio, cs_a, ad_b)).otherwise(0.0), F.when(ad_a != "", kernel(S.set_ratio, cs_b, ad_a)).otherwise(0.0)
        ),
        "q_core_a": F.size(core_a).cast("double"),
        "q_core_b": F.size(core_b).cast("double"),
        "q_name_a": F.length(nn_a).cast("double"),
        "q_name_b": F.length(nn_b).cast("double"),
        "q_addr_a": F.size(at_a).cast("double"),
        "q_addr_b": F.size(at_b).cast("double"),
        "q_dba_a": _flag(both("has_dba")[0]),
        "q_dba_b": _flag(both("has_dba")[1]),
        "q_legal_a": _flag(both("legal")[0] != ""),
        "q_legal_b": _flag(both("legal")[1] != ""),
        "q_native_b": _flag(both("native")[1]),
        "q_url_b": _flag(url_b != ""),
        "q_short_a": _flag((F.size(core_a) == 1) & (F.length(kj_a) <= 5)),
        "q_short_b": _flag((F.size(core_b) == 1) & (F.length(kj_b) <= 5)),
        "q_idf_a": _total(F.col("a")["core_idf"]),
        "q_idf_b": _total(F.col("b")["core_idf"]),
        **{
            f"{side}_{f}": F.col(side)[f].cast("double")
            for side, fields in (
                ("a", ("f_core_s1", "f_core_s23", "f_addr_s1", "f_core_s1_r", "f_core_s23_r", "f_addr_s1_r")),
                ("b", ("f_core_s1", "f_core_s23", "f_addr_s23", "f_core_s1_r", "f_core_s23_r", "f_addr_s23_r")),
            )
            for f in fields
        },
    }
    rows = joined.withColumns(features).withColumns(
        {
            "x_prod": F.when(a_tset < 0, F.lit(S.UNKNOWN)).otherwise(n_tset * a_tset / 1e4),
            "x_min": F.when(a_tset < 0, F.lit(S.UNKNOWN)).otherwise(F.least(n_tset, a_tset)),
        }
    )
    return rows.drop("a", "b")


def provenance(candidates: DataFrame, tops: dict[str, int], rev_k: int, second_source: Column, left_id: str = "i1", right_id: str = "i23") -> DataFrame:
    """How a pair was found: source, ranks and scores of passes, competition and dense search; null takes its fixed value.

    Columns that the candidates lack are filled likewise, so models always see one layout.
    """
    fixed = {f"rank_{p}": k + 1 for p, k in tops.items()} | {f"score_{p}": 0 for p in tops} | {"rev_rank": rev_k + 1, "rev_score": 0}
    fixed |= {c: 0 for c in ("p6", "n_passes", "blk", "blk_rank", "blk_gap", "blk_rev_rank", "n_cand", "rev_n", "blk_rev_gap")}
    fixed |= {"dcos": -1, "drank": 99, "drev_rank": 9, "in_blk": 1}
    columns = [
        (F.coalesce(F.col(c).cast("double"), F.lit(float(v))) if c in candidates.columns else F.lit(float(v))).alias(c) for c, v in fixed.items()
    ]
    return candidates.select(left_id, right_id, second_source.cast("double").alias("src3"), *columns)


def layout(features: DataFrame, found: DataFrame, left_id: str = "i1", right_id: str = "i23") -> DataFrame:
    """One row of numbers a pair: its ids, then the comparison features, then the columns of ``provenance``, in that order."""
    rows = features.join(found, [left_id, right_id])
    own = [c for c in features.columns if c not in (left_id, right_id)]
    more = [c for c in found.columns if c not in (left_id, right_id)]
    return rows.select(left_id, right_id, *[F.col(c).cast("float").alias(c) for c in [*own, *more]])
