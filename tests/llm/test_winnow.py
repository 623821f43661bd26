import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from weft.llm import winnow

K, W, P, B = winnow.K, winnow.WINDOW, winnow.PRIME, winnow.BASE


CODES = {}


def learn(spark, some):
    """Spark's 32-bit hash of every character pair, for the definition below."""
    pairs = sorted({(a, b) for t in some if t for a, b in zip(t, t[1:])} - CODES.keys())
    rows = spark.createDataFrame(pairs or [("", "")], "a string, b string").select("a", "b", F.hash("a", "b").alias("h"))
    CODES.update({(r.a, r.b): r.h for r in rows.collect()})


def brute(text):
    """Winnowing as the definition says: [(hash, position)], by position."""
    if not text:
        return []
    if len(text) < K:
        return [(xxhash.xxh64_intdigest(text.encode(), 42) & P, 0)]
    code = [CODES[pair] for pair in zip(text, text[1:])]
    grams = [sum(code[i + j] * B ** ((K - 2 - j) // 2) for j in range(0, K, 2)) % P for i in range(len(text) - K + 1)]
    chosen = set()
    for s in range(max(1, len(grams) - W + 1)):
        window = range(s, min(len(grams), s + W))
        chosen.add(min(window, key=lambda i: (grams[i], -i)))
    return [(grams[i], i) for i in sorted(chosen)]


def texts():
    rng = random.Random(4)
    out = [None, "", "a", "abcdefg", "abcdefgh", "abcdefghi", "x" * 40, "é😀中" * 9, "ab" * 30]
    for n in (22, 23, 24, 29, 30, 31, 32, 33, 45, 100, 8191 + 22, 8192 + 22, 8193 + 22, 20000):
        out.append("".join(rng.choice("abc é😀\n") for _ in range(n)))
    return out


def test_fingerprints_equal_the_definition(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    learn(spark, texts())
    for r in winnow.fingerprints(df).collect():
        assert [(x.hash, x.position) for x in r.fingerprint] == brute(texts()[r.doc_id])


def test_edited_and_next(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 3)
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in winnow.edited_next(df).collect()}
    order = sorted(rows)

    def edit(t, nxt):
        q = len(t) // 4
        return t[: len(t) - q] + nxt[:q]

    learn(spark, [t for _, t in order] + [edit(t or "", n or "") for (_, t), (_, n) in zip(order, order[1:] + order[:1])])
    assert len(got) == len(rows)

    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return 1.0 if not a | b else len(a & b) / len(a | b)

    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        edited = edit(t, nxt)
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        pack = [h * 2**32 - p for h, p in brute(t)]
        assert list(r.choices) == pack
        assert list(r.edited_choices) == [h * 2**32 - p for h, p in brute(edited)]
        assert abs(r.near_edited - near(brute(t), brute(edited))) < 1e-12
        assert abs(r.near_next - near(brute(t), brute(nxt))) < 1e-12


def test_small_tables(spark):
    df = spark.createDataFrame([(5, "only one document in here")], "doc_id long, text string")
    r = winnow.edited_next(df).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert winnow.edited_next(df.where(F.lit(False))).collect() == []
    same = [(None, "aaaa bbbb cccc"), (None, "dddd eeee ffff"), (1, "same text here"), (1, "same text here")]
    rows = winnow.edited_next(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert len(rows) == 4 and len({tuple(r.choices) for r in rows if r.doc_id == 1}) == 1


def test_many_equal_rows_are_worked_off_as_one(spark, monkeypatch):
    rows = [(None, "many equal rows of one text")] * 40 + [(None, "another text"), (3, "the last text of all")] + [(3, "t")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = winnow.edited_next(df).collect()
    monkeypatch.setattr(winnow, "HOT_ROWS", 5)
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 2)
    assert sorted(map(str, winnow.edited_next(df).collect())) == sorted(map(str, plain)) and len(plain) == len(rows)


def test_ids_of_any_type(spark):
    rows = [("b", "first text in order b"), ("a", "text of a"), (None, "no id here"), ("c", "and the last one")]
    got = {r.doc_id: r for r in winnow.edited_next(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = {None: "no id here"[:8] + "te", "a": "text of" + "fi", "b": "first text in or" + "and t", "c": "and the last" + "no i"}
    for d, edited in want.items():
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d


def test_beginnings_are_read_off_the_choices_of_the_whole(spark):
    """The edited text's windows before and after the edit's begin were all worked off again."""
    rows = [(t, m) for t in texts() if t and len(t) >= K + W - 1 for m in {K + W - 1, K + W, len(t) // 4, len(t) * 3 // 4, len(t)} if K + W - 1 <= m]
    df = spark.createDataFrame(rows, "t string, m int")
    whole, part = winnow._beginning(winnow.packed(F.col("t")), F.col("m")), winnow.packed(F.substring(F.col("t"), F.lit(1), F.col("m")))
    assert df.where(whole != part).count() == 0 and df.where(whole == part).count() == len(rows) > 40
