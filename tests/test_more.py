from pyspark.sql import functions as F

from weft.functions import noise
from weft.operators import context, decide, dense, enrich, metrics, parse
from weft.plans import block


def test_noise_is_the_same_for_a_key_and_mostly_keeps_words(spark):
    rows = spark.createDataFrame([(i, "Acme Trading Company Ltd", "12 Main Street, Springfield, 007 Area") for i in range(200)], "k int, n string, a string")
    noisy = rows.select("k", noise.with_noise(noise.noisy_name, F.col("n"), F.col("k")).alias("n"), noise.with_noise(noise.noisy_address, F.col("a"), F.col("k"), 1).alias("a"))
    one, two = ({r.k: (r.n, r.a) for r in noisy.repartition(p).collect()} for p in (1, 5))
    assert one == two and len({n for n, _ in one.values()}) > 20
    assert sum("cme" in n.lower() for n, _ in one.values()) > 150
    assert noise.noisy_name("", 1) in ("", *noise.LEGAL_FORMS) and noise.noisy_address("", 3) == ""
    text = rows.limit(1).select(noise.record_text(F.col("n"), F.lit("N/A")).alias("t"), noise.record_text(F.lit("x"), F.col("a")).alias("u")).first()
    assert text.t == "query: Acme Trading Company Ltd" and text.u.startswith("query: x | 12 Main")


def enriched(spark, rows):
    df = spark.createDataFrame(rows, "id long, cty string, business_name string, business_address string")
    return parse.parse_records(df).withColumn("anchor", enrich.anchor(F.col("house"), F.col("street")))


def test_blocking_finds_variants_inside_a_label_only(spark):
    left = enriched(spark, [(1, "us", "Zeclarsoft LLC", "12 Main Street, Springfield"), (2, "us", "Other Place Inc", "7 Oak Avenue"), (3, "fr", "Zeclarsoft LLC", "12 Main Street")])
    right = enriched(
        spark,
        [
            (10, "us", "Zeclar soft L.L.C.", "12 Main St, Springfield"),
            (11, "us", "Oter Place", "7 Oak Ave"),
            (12, "fr", "Boulangerie", "3 rue Haute"),
            (13, "us", "Bakery", ""),
        ],
    )
    got = block.block(left, right).collect()
    pairs = {(r.i1, r.i23) for r in got}
    assert {(1, 10), (2, 11)} <= pairs and not any(a == 3 and b in (10, 11) for a, b in pairs)
    best = next(r for r in got if (r.i1, r.i23) == (1, 10))
    assert best.found_p1 == 1 and best.found_p3 == 1 and best.n_passes >= 3 and best.found_rev == 1
    ranked = block.scored(block.block(left, right), lambda rows, out: rows.withColumn(out, F.col("n_passes").cast("double")), 1)
    assert ranked.groupBy("i1").count().where("count > 1").count() == 0
    labelled = block.block(left, right).groupBy("cty").count().collect()
    assert {r.cty for r in labelled} <= {"us", "fr"}


def test_dense_union(spark):
    lexical = spark.createDataFrame([("c", 1, 2)], "cty string, i1 long, i23 long")
    left = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 3, [0.0, 1.0]), ("d", 9, [1.0, 1.0])], "cty string, i1 long, v array<double>")
    right = spark.createDataFrame([("c", 2, [0.9, 0.1]), ("c", 4, [0.1, 0.9])], "cty string, i23 long, v array<double>")
    found = dense.forward_reverse(dense.similarities(left, right, 1, 1, block=1), 1, 1)
    assert {(r.i1, r.i23, r.drank, r.drev_rank) for r in found.collect()} == {(1, 2, 1, 1), (3, 4, 1, 1)}
    rows = {(r.i1, r.i23): (r.in_blk, r.drank) for r in dense.add_dense(lexical, found).collect()}
    assert rows == {(1, 2): (1, 1), (3, 4): (0, 1)}


def test_rules_and_bands(spark):
    edges = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.002), (2, 2, 0.6)], "i1 long, i23 long, p double")
    truth = spark.createDataFrame([(1, 1), (2, 2)], "i1 long, i23 long")
    rules = decide.tune(edges, truth, 2, (0.0, 0.1), (1.0, 0.9), (0.5,)).collect()
    assert len(rules) == 3 and all(r.macro_f05 == 1.0 for r in rules)
    assert edges.where(context.uncertain(F.col("p"))).count() == 2
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, comp long")
    same = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "node long, entity long")
    row = metrics.cluster_quality(nodes, same).first()
    assert row.purity == 1.0 and abs(row.completeness - 1 / 3) < 1e-12
    assert enrich.coverage(nodes.withColumn("s", F.lit("")), ["s"], "comp").where("s > 0").count() == 0
