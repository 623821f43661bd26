import itertools

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators import blocking, context, decide, em, graph, metrics, models, validate
from weft.sources import records as R
from weft.sources import sinks
from weft.streaming import incremental


def frame(spark, rows):
    return spark.createDataFrame(rows, "i1 long, i23 long, p double")


def best_length(ps, every, floor=0.1, most=10, empty=0.5):
    """Expected F0.5 by all outcomes."""
    kept = sorted((p for p in ps if p >= floor), reverse=True)[:most]
    best, at = empty, 0
    for k in range(1, len(kept) + 1):
        rest = max(sum(every) - sum(kept[:k]), 0)
        value = 0.0
        for outcome in itertools.product((0, 1), repeat=k):
            w = 1.0
            for o, p in zip(outcome, kept):
                w *= p if o else 1 - p
            t = sum(outcome)
            value += w * (5 * t / (5 * t + rest + 4 * (k - t)) if t else 0)
        if value > best + 1e-12:
            best, at = value, k
    return at, best


def test_expected_f_equals_all_outcomes(spark):
    import random

    rng = random.Random(3)
    lists = {i: [round(rng.random() ** rng.choice((0.3, 1, 3)), 3) for _ in range(rng.randrange(1, 8))] for i in range(60)}
    edges = frame(spark, [(i, j, p) for i, ps in lists.items() for j, p in enumerate(ps)])
    got = {r.i1: (r.n_selected, r.expected) for r in decide.expected_f(edges).collect()}
    for i, ps in lists.items():
        if not any(p >= 0.1 for p in ps):
            assert i not in got
            continue
        k, value = best_length(ps, ps)
        assert got[i][0] == k and got[i][1] == pytest.approx(value, abs=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.sampled_from([0.1, 0.5, 0.9])), min_size=1, max_size=25, unique_by=lambda x: x[:2]))
def test_exclusive_gives_each_record_once_whatever_the_order(spark, rows):
    own = decide.exclusive(frame(spark, rows), 0.2, 0.9).collect()
    again = decide.exclusive(frame(spark, rows[::-1]), 0.2, 0.9).collect()
    assert sorted(map(tuple, own)) == sorted(map(tuple, again))
    assert len({r.i23 for r in own}) == len(own) == len({r[1] for r in rows})


def test_propagate_only_raises(spark):
    edges = frame(spark, [(1, 1, 0.9), (1, 2, 0.2), (1, 3, 0.1), (2, 1, 0.4)])
    links = spark.createDataFrame([(1, 1, 2, 0.96), (1, 2, 3, 0.5)], "i1 long, x long, y long, p_link double")
    got = {(r.i1, r.i23): r.p for r in decide.propagate(edges, links).collect()}
    assert got == {(1, 1): 0.9, (1, 2): pytest.approx(0.864), (1, 3): 0.1, (2, 1): 0.4}


def test_macro_f(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "i1 long, i23 long")
    entities = spark.createDataFrame([(1,), (2,), (3,), (4,)], "i1 long")
    scores = metrics.entity_scores(pairs([(1, 47), (1, 193), (1, 812), (3, 9)]), pairs([(1, 47), (1, 812), (4, 2)]), entities)
    got = {r.i1: r.f05 for r in scores.collect()}
    assert got == {1: pytest.approx(0.7142857), 2: 1.0, 3: 0.0, 4: 0.0}
    none = metrics.entity_scores(pairs([(9, 9)]).where("false"), pairs([(4, 2)]), entities)
    assert metrics.macro(none).first().macro_f05 == pytest.approx(0.75)
    interval = metrics.bootstrap(scores.withColumn("z", F.lit(0.0)), "f05", "z", "i1").first()
    assert interval.low <= interval.mean <= interval.high


def test_assignment_is_the_best_of_all():
    edges = pd.DataFrame({"i1": [1, 1, 2, 2], "i23": [7, 8, 8, 9], "p": [0.9, 0.6, 0.7, 0.2]})
    got = graph.assign(edges)
    lists = {1: {7: 0.9, 8: 0.6}, 2: {8: 0.7, 9: 0.2}}
    value = {r.i23: r.i1 for r in got.itertuples()}
    # only record 8 is claimed twice; the others stay with their entity
    every = [dict(zip((7, 8, 9), o)) for o in itertools.product((1,), (1, 2, None), (2,))]
    assert graph._value(value, lists) == pytest.approx(max(graph._value(o, lists) for o in every))
    assert graph.assign(edges, most=1)["i23"].is_unique


def test_entities_are_worth_their_best_prefix():
    """Against all outcomes: the expected F0.5 of every prefix, with nothing elsewhere."""
    for ps in ([0.9, 0.6, 0.2], [0.1, 0.05], [0.5]):
        def expected(k, ps=ps):
            total = 0.0
            for truth in itertools.product((0, 1), repeat=len(ps)):
                weight = 1.0
                for t, q in zip(truth, ps):
                    weight *= q if t else 1 - q
                tp, n = sum(truth[:k]), sum(truth)
                # matches that are left out count by their expectation
                unseen = sum(ps[k:])
                total += weight * ((1.0 if not n else 0.0) if k == 0 else 5 * tp / (5 * tp + unseen + 4 * (k - tp)) if tp else 0.0)
            return total
        assert graph._best_prefix(ps, 0.0) == pytest.approx(max(expected(k) for k in range(len(ps) + 1)))


def test_disputed_records_are_solved_by_component(spark):
    rows = [(1, 7, 0.9), (1, 8, 0.6), (2, 8, 0.7), (2, 9, 0.2), (5, 50, 0.4), (6, 60, 0.3), (6, 61, 0.9), (7, 61, 0.2), (8, 90, 0.01)]
    edges = spark.createDataFrame(rows, "i1 long, i23 long, p double")
    got = {(r.i1, r.i23) for r in graph.solve(edges).collect()}
    want = set()
    for part in ([r for r in rows if r[0] in (1, 2)], [r for r in rows if r[0] in (6, 7)]):
        want |= {(r.i1, r.i23) for r in graph.assign(pd.DataFrame(part, columns=["i1", "i23", "p"])).itertuples()}
    assert got == want | {(5, 50)}
    plain = {(r.i1, r.i23) for r in graph.solve(edges, most_shared=0).collect()}
    assert plain == {(1, 7), (2, 8), (2, 9), (5, 50), (6, 60), (6, 61)}


def test_components_and_capped_clusters(spark):
    links = spark.createDataFrame(
        [(i, i + 1, 0.96) for i in range(12)] + [(0, 1, 0.991), (20, 21, 0.99), (40, 40, 0.99)], "x long, y long, p_link double"
    )
    labels = {r.node: r.comp for r in graph.components(links, "x", "y").collect()}
    assert labels == {i: 0 for i in range(13)} | {20: 20, 21: 20, 40: 40}
    small = {r.node: r.comp for r in graph.clusters(links, 8).collect()}
    assert small[0] == small[1] == 0 and small[20] == small[21] == 20 and 5 not in small


def test_prior_and_grid(spark):
    edges = frame(spark, [(i, i, i / 20) for i in range(20)])
    shift = decide.match_prior(edges, 0.25, 20)
    assert edges.where(decide.shifted(F.col("p"), shift) >= 0.5).count() in (4, 5, 6)
    assert decide.priority_union(edges, edges.withColumn("p", F.lit(9.0)), ["i1", "i23"]).agg(F.max("p")).first()[0] < 1


def test_closure_and_spread(spark):
    edges = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (2, 6, 1), (3, 6, 4), (3, 5, 3)], "i1 long, i23 long, blk_rev_rank int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i1 long")
    got = {(r.i1, r.i23) for r in context.closure(edges, ids(1), ids(2)).collect()}
    assert got == {(1, 5), (3, 5)}
    row = context.score_spread(spark.createDataFrame([(0.2, 0.8, None)], "a double, b double, c double"), ["a", "b", "c"]).first()
    assert (row.unc_mean, row.unc_std, row.unc_votes, row.unc_disagree, row.unc_present) == (pytest.approx(0.5), pytest.approx(0.3), 1, 1, 2)


def test_weights_recover_a_mixture(spark):
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        y = rng.random() < 0.2
        rows.append((int(y), *(2 if rng.random() < (0.9 if y else 0.1) else 1 for _ in range(4))))
    df = spark.createDataFrame(rows, "y int, a int, b int, c int, d int")
    levels = dict.fromkeys("abcd", 3)
    start = em.Weights({f: [0.01, 0.3, 0.69] for f in levels}, {f: [0.01, 0.69, 0.3] for f in levels}, 0.5)
    fitted, known = em.fit(df, levels, start), em.supervised(df, levels)
    assert fitted.prior == pytest.approx(known.prior, abs=0.05)
    assert fitted.m["a"][2] == pytest.approx(known.m["a"][2], abs=0.06)
    scored = known.scored(df)
    assert scored.where("y = 1").agg(F.avg("posterior")).first()[0] > 0.7
    assert em.banded(F.col("a"), (1, 2)) is not None and len(em.levels(df)) == 0


def test_scorers(spark):
    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 6)) for i in range(300)], "i1 long, f double, y int")
    fitted = models.out_of_fold(rows, "i1", lambda kept: models.scorer(kept, ["f"]))
    assert fitted.count() == 300 and models.auc(fitted, "p_oof").first().auc == 1.0
    rising = models.monotone(rows.withColumn("g", -F.col("f")), ["f", "g"], ["g"])(rows.withColumn("g", -F.col("f")))
    assert rising.count() == 300
    assert models.auc(models.boosted(rows, ["f"], trees=3)(rows)).first().auc == 1.0
    curve = models.isotonic(rows.withColumn("p", F.col("f") / 10))
    far = curve(spark.createDataFrame([(-5.0,), (9.0,)], "p double")).orderBy("p").collect()
    assert [r.p_cal for r in far] == [0.0, 1.0]
    roles = rows.select(models.role(F.col("i1"), {"mine": (0.0, 0.5)}).alias("r")).groupBy("r").count().collect()
    assert {r.r for r in roles} == {"mine", "context"}


def test_tsv_round_trip(spark, tmp_path):
    text = 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "q\tNA\t France \nS1-2\tnull\t\tIN\n'
    for n in (1, 2, 3):
        (tmp_path / f"t_source{n}.tsv").write_text(text.replace("S1-", f"S{n}-"))
    left, right = R.load_split(spark, str(tmp_path), "t")
    rows = {r.entity_id: r for r in left.collect()}
    assert rows["S1-1"].business_name == 'A "q' and rows["S1-1"].business_address == "NA" and rows["S1-1"].cty == "france"
    assert rows["S1-2"].business_name == "null" and rows["S1-2"].business_address == ""
    assert right.count() == 4 and {r.src for r in right.collect()} == {"S2", "S3"}
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-9"), ("S1-1", "S2-9")], "a string, b string")
    lists = sinks.id_lists(pairs, left, "entity_id", "a", "b", "ids")
    sinks.write_tsv(lists, str(tmp_path / "out"), ["entity_id"])
    back = R.read_tsv(spark, str(tmp_path / "out"), R.TRUTH)
    assert {(r.source1_entity_id, r.matched_entity_ids) for r in back.collect()} == {("S1-1", "S2-9,S3-2"), ("S1-2", "")}
    assert R.id_pairs(back, "source1_entity_id", "matched_entity_ids").count() == 2
    calls = []
    make = lambda: calls.append(1) or lists
    for _ in range(2):
        sinks.memoised(spark, str(tmp_path / "memo"), make)
    assert calls == [1]
    kept, truth = R.smoke_sample(left, pairs.toDF("s1_id", "s23_id"), parts=1)
    assert kept.count() == 2 and truth.count() == 3


def test_validator_and_outside(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9"), ("S1-1", ""), ("S1-7", "X-1,S3-5")], "k string, ids string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.rule: r.n_offenders for r in validate.results(lists, "k", "ids", ids("S1-1", "S1-2"), ids("S2-1"), "S1-", ["S2-", "S3-"]).collect()}
    assert got == {
        "duplicate_rows": 1, "repeated_ids": 1, "self_matches": 1, "wrong_prefix": 1, "unknown_ids": 1, "missing_rows": 1, "extra_rows": 1,
    }
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert validate.outside(pairs, pairs.where("b = 2"), "a", "b").first().n_outside == 1


def test_streamed_records_meet_fixed_postings(spark, tmp_path):
    posted = spark.createDataFrame([("c", 7, "w:x", 2.0), ("c", 8, "w:y", 1.0)], "cty string, e long, key string, idf double")
    batch = spark.createDataFrame([("c", 1, ["w:x", "w:y", "w:x"]), ("d", 2, ["w:x"])], "cty string, q long, keys array<string>")
    batch.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def decision(rows):
        return incremental.candidates(rows, posted, "q", "e")

    run = incremental.link_batches(arriving, decision, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {(r.q, r.e, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 7, 2.0), (1, 8, 1.0)}


def test_cap_and_top(spark):
    assert blocking.cap(10, 2e-4) == 20 and blocking.cap(1_000_000, 2e-4) == 200
    rows = frame(spark, [(1, 2, 0.5), (1, 1, 0.5), (1, 3, 0.9)])
    assert [r.i23 for r in blocking.top(rows, ["i1"], [F.desc("p"), F.col("i23")], 2).orderBy("rank").collect()] == [3, 1]
