"""Studies, pools, lists and sources on small tables with known answers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.functions import noise, similarity as S, text as X
from weft.operators import blocking, compare, decide, dense, em, models, studies
from weft.sources import records, sinks


def test_results_and_ids_are_read_back(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-4,S3-5"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    sinks.write_tsv(lists, str(tmp_path / "out"), ["source1_entity_id"])
    assert sorted(map(tuple, records.read_results(spark, str(tmp_path / "out")).collect())) == [("S1-1", "S2-4"), ("S1-1", "S3-5")]
    (tmp_path / "ids.tsv").write_text("entity_id\tname\nS1-1\ta\nS1-1\tb\nS1-2\tc\n")
    assert sorted(r.id for r in records.read_ids(spark, str(tmp_path / "ids.tsv")).collect()) == ["S1-1", "S1-2"]
    path = str(tmp_path / "ledger")
    sinks.append_ledger(spark, path, {"f05": 0.5, "n": 3}, "one")
    got = sinks.append_ledger(spark, path, {"f05": 0.75}, "one").collect()
    assert {(r.step, r.measure): r.value for r in got} == {("one", "f05"): 0.75, ("one", "n"): 3.0}


def test_density_sample_keeps_matches_with_their_entity(spark):
    left = spark.range(400).select(F.col("id").alias("i1"))
    right = spark.range(2000).select(F.col("id").alias("i23"))
    truth = spark.range(800).select((F.col("id") % 400).alias("i1"), F.col("id").alias("i23"))
    own, found, pairs = studies.density_sample(left, right, truth, 0.0, 0.25)
    ids = {r.i1 for r in own.collect()}
    assert 60 < len(ids) < 140
    assert {r.i23 for r in pairs.collect()} == {i for i in range(800) if i % 400 in ids}
    kept = {r.i23 for r in found.collect()}
    assert {i for i in kept if i < 800} == {r.i23 for r in pairs.collect()} and 200 < len([i for i in kept if i >= 800]) < 400


def test_leave_one_out_and_ablation(spark):
    rows = [(i, "ab"[i // 100], float(i % 10), float(i % 3), int(i % 10 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, cty string, x double, z double, y int")
    fit = lambda kept, features=("x", "z"): models.scorer(kept, list(features), iterations=20)
    got = studies.leave_one_out(df, ["a", "b"], "cty", fit, lambda own: models.auc(own, "p_loo")).collect()
    assert {r.cty for r in got} == {"a", "b"} and all(r.auc > 0.99 for r in got)
    table = studies.ablation(df, {"x": ["x"], "z": ["z"]}, fit, lambda own: models.auc(own, "p_abl"))
    aucs = {r["without"]: r.auc for r in table.collect()}
    assert aucs[""] > 0.99 and aucs["z"] > 0.99 and aucs["x"] < 0.7


def test_auc_of_bands_is_that_of_all_pairs(spark):
    rows = [(round((i * 37 % 101) / 101, 3), int(i * 7 % 13 > 5)) for i in range(300)]
    want = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    df = spark.createDataFrame(rows, "p double, y int")
    for bands in (1, 7, 1024):
        assert models.auc(df, bands=bands).first().auc == pytest.approx(sum(want) / len(want))


def test_early_stopping_and_final_length(spark):
    rows = spark.createDataFrame([(float(i % 7), int(i % 7 > 3), i % 5 == 0) for i in range(200)], "x double, y int, held boolean")
    model, n = models.early_stopped(rows, ["x"], F.col("held"), trees=10, depth=2)
    assert 1 <= n <= 10 and model(rows, "p").where("(p > 0.5) = (y = 1)").count() == 200
    assert models.final_length([10, 20]) == 50 and models.final_length([100, 120]) == 121


def test_rules_are_chosen_and_applied(spark):
    edges = spark.createDataFrame([(1, 7, 0.9), (2, 7, 0.85), (1, 8, 0.6), (2, 9, 0.3)], "i1 long, i23 long, p double")
    truth = spark.createDataFrame([(1, 7), (1, 8)], "i1 long, i23 long")
    tuned = decide.tune(edges, truth, 2, (0.0, 0.1), (1.0, 0.5), (0.3, 0.5))
    assert tuned.count() == 6
    rule = decide.best_rule(tuned)
    assert rule == {"margin": 0.0, "penalty": 1.0, "threshold": 0.5, "macro_f05": 1.0}
    got = decide.apply_rule(edges, rule, wanted=spark.createDataFrame([(1,)], "i1 long"))
    assert sorted((r.i1, r.i23) for r in got.collect()) == [(1, 7), (1, 8)]
    costs = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.2), (1, 2, 0.2), (2, 0, 0.1)], "i1 long, k int, cost double")
    assert {r.i1: r.k for r in decide.cheapest_length(costs).collect()} == {1: 1, 2: 0}
    lengths = decide.tune_lengths(edges, truth, spark.createDataFrame([(1,), (2,)], "i1 long"), 0.5, (0.1,), (1, 5))
    assert {r.max_k for r in lengths.collect()} == {1, 5}


def test_weights_of_parts_are_those_of_the_parts_alone(spark):
    rows = [(i % 3, i % 5, i % 2, i * 7 % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, a int, b int, c int")
    sizes = {"a": 5, "b": 2, "c": 4}
    start = em.Weights({f: [1 / n] * n for f, n in sizes.items()}, {f: [(k + 1) / (n * (n + 1) / 2) for k in range(n)] for f, n in sizes.items()}, 0.3)
    by, without = em.fit_by(df, sizes, start, "g"), em.fit_without(df, sizes, start, "g")
    for g in range(3):
        for found, own in ((by[g], df.where(F.col("g") == g)), (without[g], df.where(F.col("g") != g))):
            want = em.fit(own, sizes, start)
            assert all(found.m[f] == pytest.approx(want.m[f]) for f in sizes) and found.prior == pytest.approx(want.prior)
    assert em.scored_by(df, by, "g").count() == 400
    # more vectors than the driver takes: the same rounds as Spark jobs
    here, there = em.fit(df, sizes, start), em.fit(df, sizes, start, most=3)
    assert all(here.m[f] == pytest.approx(there.m[f]) and here.u[f] == pytest.approx(there.u[f]) for f in sizes)
    labelled = em.supervised(df.withColumn("y", F.col("b")), sizes)
    assert labelled.prior == 0.5 and labelled.m["b"] == pytest.approx([1 / 202, 201 / 202])


def test_layout_has_every_column_in_order(spark):
    features = spark.createDataFrame([(1, 2, 0.5)], "i1 long, i23 long, n_ratio double")
    found = compare.provenance(spark.createDataFrame([(1, 2, None, 3)], "i1 long, i23 long, rank_p1 int, n_passes int"), {"p1": 30}, 5, F.lit(True))
    row = compare.layout(features, found).first()
    assert row.asDict()["rank_p1"] == 31 and row.n_passes == 3 and row.src3 == 1 and row.dcos == -1 and row.drank == 99 and row.rev_rank == 6
    assert compare.layout(features, found).columns[:5] == ["i1", "i23", "n_ratio", "src3", "rank_p1"]


def test_pool_of_both_searches(spark):
    lexical = spark.createDataFrame([(1, 10, 2, 1), (1, 11, 1, 0)], "i1 long, i23 long, n_passes int, p6 int")
    near = spark.createDataFrame([(1, 11, 0.9, 1, None), (1, 12, 0.8, 2, None), (1, 13, 0.1, 99, 1), (1, 14, 0.2, 50, None)], "i1 long, i23 long, dcos double, drank int, drev_rank int")
    got = {r.i23: r for r in dense.filled(dense.pool(lexical, near)).collect()}
    assert set(got) == {10, 11, 12, 13} and all(r.n_cand == 4 for r in got.values())
    assert (got[10].in_lexical, got[10].dcos, got[10].drank) == (1, -1.0, 21) and (got[13].in_lexical, got[13].n_passes, got[13].drev_rank) == (0, 0, 1)


def test_reports_of_lists_and_passes(spark):
    found = spark.createDataFrame([(1, 10, 1, 1), (1, 11, 1, 0), (2, 20, 0, 1)], "i1 long, i23 long, a int, b int")
    truth = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "i1 long, i23 long")
    entities = spark.createDataFrame([(1,), (2,), (3,)], "i1 long")
    row = blocking.list_report(found, truth, entities).first()
    assert (row.mean, row.longest, row.ceiling) == (1.0, 2, 0.5)
    assert row.oracle_f05 == pytest.approx((1 + 5 / 6 + 1) / 3)
    passes = {r["pass"]: (r.recall_alone, r.only_by_this) for r in blocking.pass_report(found, truth, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert passes["a"] == (pytest.approx(1 / 3), 0.0) and passes["b"] == (pytest.approx(2 / 3), pytest.approx(1 / 3))


def test_first_generation_and_texts(spark):
    df = spark.createDataFrame([("Foo's Street & Co", "N/A", "x", "12 Main Road"), (None, " - ", "y", None)], "a string, b string, c string, d string")
    rows = df.select(X.first_norm(F.col("a")).alias("a"), X.first_norm(F.col("b")).alias("b"), noise.pair_text(F.col("c"), F.col("b"), F.lit(2)).alias("t")).collect()
    assert (rows[0].a, rows[0].b, rows[0].t) == ("foos st & co", "", "x ; dup 2") and rows[1].a == ""
    feats = S.first_features(df.na.fill(""), "a", "c", "b", "d").collect()
    assert feats[0].len_b == 1 and feats[0].num_jacc == -1.0 and feats[1].addr_empty_b == 1 and feats[0].name_in_addr >= 0


def test_isotonic_curve_is_the_min_max_formula(spark):
    rows = [(round(i / 40, 3), int((i * 17 % 40) < i)) for i in range(40) for _ in range(2)]
    got = {r.p: r.p_cal for r in models.isotonic(spark.createDataFrame(rows, "p double, y int"))(spark.createDataFrame(rows, "p double, y int")).collect()}
    table = pd.DataFrame(rows, columns=["p", "y"]).groupby("p")["y"].agg(["sum", "count"])
    s, n = table["sum"].tolist(), table["count"].tolist()
    for i, p in enumerate(table.index):
        want = max(min(sum(s[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(s))) for a in range(i + 1))
        assert got[p] == pytest.approx(want, abs=1e-9)
