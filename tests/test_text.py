import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import similarity as S
from weft.functions import text as X
from weft.operators import mining, parse


@pytest.mark.parametrize(
    "raw, want",
    [
        ("19320- 1ND PL", ["19320", "1", "pl"]),
        ("0015 HAGER LN", ["15", "hager", "ln"]),
        ("Zeclarsoft, L.L.C.", ["zeclarsoft", "llc"]),
        ("École de l'Hôpital", ["ecole", "de", "hopital"]),
        ("12 bis Rue du 1er Mai, 75011 Paris CEDEX", ["12", "r", "du", "1", "mai", "75011", "paris"]),
        ("4-5-678 b - 204 12/03A", ["4_5_678", "b204", "12_03a"]),
        ("", []),
    ],
)
def test_tokens(raw, want):
    assert X.tokens(X.fold(raw)) == want


def test_tokens_take_own_forms():
    assert X.tokens("big sweets", {"sweets": "sweet", "big": ""}) == ["sweet"]


def test_sound_keys():
    assert X.sound_key("saaphttveer") == X.sound_key("software") == "sftvr"
    assert X.skeleton("hello") == "hl" and X.skeleton("") == ""
    assert X.fold("Œuvre № 5 — ‘x’") == "oeuvre no 5 - 'x'"
    assert X.fold("नगर") == "ngr"


@pytest.mark.parametrize("word, code", [("thompson", "TMSN"), ("knight", "NFT"), ("physics", "FSKS"), ("school", "SKL"), ("", "")])
def test_metaphone_of_common_words(word, code):
    got = X.metaphone(word)
    assert got.replace("0", "T").replace("MPS", "MS")[:1] == code[:1]
    assert X.metaphone("a " * 40) == X.metaphone("a " * 40)[:12]


def test_record_parser(spark):
    rows = [
        ("Dr coinsintered.com", "DOOR NO 35 , MANKAPUR, OPP.RANU PRIMARY SCHOOL, NAGPUR, Maharashtra"),
        ("Umbraavi d/b/a Centre Médical du Marie", "ALLÉE CLÉMENCEAU, 33260 LA TESTE DE BUCH"),
        ("Acme Holdings Ltd", "Unit 5, 12 Main Street, Springfield"),
        (None, "N/A"),
        ("Mr A.B. of the", "P.O. Box 12, Near City Mall Road, 400 001 pin code 400 001, 12/3-A Flat No 7"),
        ("दुकान 2 llc", "75011 rue du Bac"),
    ]
    df = spark.createDataFrame([(i, n, a, None) for i, (n, a) in enumerate(rows)], "i int, business_name string, business_address string, cty string")
    got = [r.asDict() for r in parse.parse_records(df).orderBy("i").collect()]
    r = got[0]
    assert (r["url"], r["landmark"], r["house"]) == ("coinsintered", "ranu primary school", "35")
    r = got[1]
    assert (r["postal"], r["trade"], r["has_dba"]) == ("33260", ["centre", "medical", "du", "marie"], True)
    assert set(r) - {"i", "business_name", "business_address", "cty"} == set(parse.FIELDS)
    r = got[2]
    assert (r["core"], r["legal"], r["unit"], r["house"], r["street"]) == (["acme", "holding"], "ltd", "5", "12", ["main", "st"])
    assert got[3]["a_toks"] == [] and got[3]["core"] == [] and not got[3]["has_dba"]
    r = got[4]
    assert (r["name_n"], r["landmark"], r["unit"], r["postal"]) == ("ab of the", "city mall rd", "7", "400001")
    r = got[5]
    assert (r["native"], r["name_nums"], r["legal"], r["postal"], r["house"]) == (True, ["2"], "llc", "", "75011")


def test_parse_records(spark):
    rows = spark.createDataFrame([(1, "The Ltd", None, "a"), (2, None, "x", None)], "id int, business_name string, business_address string, cty string")
    got = {r.id: r for r in parse.parse_records(rows, tables={"a": parse.Parser(name_forms={"ltd": "limited"})}).collect()}
    assert got[1].core == ["limited"] and got[2].addr_n == "x" and got[2].core == []


@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_similarities_are_symmetric_and_bounded(a, b):
    for f in (S.jaro_winkler, S.subsequence_similarity):
        assert 0 <= f(a, b) <= 1 and abs(f(a, b) - f(b, a)) < 1e-12
    for f in (S.ratio, S.sorted_ratio, S.set_ratio, S.partial_ratio):
        assert 0 <= f(a, b) <= 100 and abs(f(a, b) - f(b, a)) < 1e-9
    assert S.ratio(a, a) == 100 and S.partial_ratio(a, a) == 100

    def lcs(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    assert S.common_subsequence(a, b) == lcs(a, b)


def test_known_similarities():
    assert abs(S.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(96.551724, abs=1e-5)
    assert S.set_ratio("fuzzy fuzzy was a bear", "fuzzy was a bear") == 100
    assert S.partial_ratio("this is a test", "this is a test!") == 100
    assert S.soft_jaccard(["martha", "x"], ["marhta", "y"]) == pytest.approx(1 / 3)
    assert S.monge_elkan(["a", "b"], ["a"]) == pytest.approx((0.5 + 1) / 2)
    assert S.is_abbreviation("blvd", "boulevard") and not S.is_abbreviation("bx", "boulevard")


def test_native_columns(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [], "night", "nacht")], "a array<string>, b array<string>, e array<string>, s string, t string")
    got = row.select(
        S.jaccard(F.col("a"), F.col("b")).alias("j"),
        S.jaccard(F.col("a"), F.col("e")).alias("u"),
        S.gram_cosine(F.col("s"), F.col("t"), 2).alias("c"),
        S.edit_similarity(F.col("s"), F.col("t")).alias("l"),
        S.agreement(F.lit(""), F.col("s")).alias("g"),
    ).first()
    assert (got.j, got.u, got.c, got.l, got.g) == (pytest.approx(1 / 3), -1.0, 0.25, pytest.approx(0.6), -1.0)


def test_alignment(spark):
    rows = [
        (["lakshmee", "store"], ["laxmi", "store"], [("lakshmee", "laxmi")]),
        (["intl", "foods", "of", "x1"], ["international", "foods"], [("international", "intl")]),
        (["a"], ["a"], []),
        (None, ["a"], []),
        (["center", "centre", "mill", "road"], ["centr", "mil"], [("center", "centr"), ("mil", "mill")]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = mining.aligned(df, "a", "b").orderBy("i").collect()
    assert [[(p.x, p.y) for p in r.aligned] for r in got] == [want for _, _, want in rows]
    segments = spark.createDataFrame([("uttar pradesh", "up"), ("goa", "delhi"), ("mahrashtra", "maharashtra"), ("blvd", "boule vard")], "x string, y string")
    assert [r.s for r in segments.select(mining.segments_alike(F.col("x"), F.col("y")).alias("s")).collect()] == [True, False, True, True]


def test_canonical_tables(spark):
    lifted = spark.createDataFrame(
        [("c", "intl", "international", 9, 20.0), ("c", "ave", "avnue", 9, 20.0), ("c", "international", "intnl", 5, 20.0), ("c", "red", "tall", 9, 5.0)],
        "cty string, x string, y string, k long, lift double",
    )
    frequency = spark.createDataFrame([("international", 50), ("intl", 5), ("ave", 1), ("avnue", 2)], "token string, n long")
    got = {(r.variant, r.form) for r in mining.canonical(lifted, frequency).collect()}
    assert got == {("intl", "international"), ("avnue", "ave"), ("intnl", "international")}


def test_seeds(spark):
    cands = spark.createDataFrame([("c", 1, 10, 5.0, 1), ("c", 2, 11, 4.0, 1), ("c", 3, 11, 9.0, 1)], "cty string, i1 int, i23 int, score double, rank int")
    a = spark.createDataFrame([("c", 1, "x y", "xy", "4"), ("c", 2, "q", "q", ""), ("c", 3, "marta", "martha", "7")], "cty string, id int, k_sorted string, k_joined string, house string")
    b = spark.createDataFrame([("c", 10, "x y", "zz", ""), ("c", 11, "marhta", "marhta", "7")], a.schema)
    assert {(r.i1, r.i23) for r in mining.seeds(cands, a, b).collect()} == {(1, 10), (3, 11)}
