import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import store
from weft.llm.common import Workspace

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True


def want(rows):
    ids = [(d, LIB.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    return ids


def check(spark, df, rows):
    folder = store.write(df, PATH, 1, Workspace(spark, "t"))
    got = store.summary(spark, folder).collect()
    ids = want(rows)
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d is not None, d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids
    )
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    back = sorted((r.doc_id is not None, r.doc_id, list(r.ids)) for r in store.read(spark, folder).collect())
    assert back == sorted((d is not None, d, i) for d, i in ids)
    return folder


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(store, "PART_ROWS", 40)
    monkeypatch.setattr(store, "FAN", 8)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    folder = check(spark, df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(r.documents for r in manifest) == df.count() and len(manifest) > 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "FAN", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    shared = " ".join(rng.choice(words) for _ in range(3000))
    rows = [(1, None), (None, "a"), (2, ""), (5, "x y"), (5, "x y"), (9, "same " * 20_000), (-4, shared)]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(i)) + " " + shared) for i in range(30)]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, start int").repartition(4)
    folder = check(spark, df, rows)
    sizes = [len(r.ids) // 2 for r in spark.read.parquet(f"{folder}/chunks").collect()]
    total = sum(len(i) for _, i in want(rows))
    assert sum(sizes) < total / 4, "shared passages are stored once"
    assert max(sizes) <= store.MOST
    check(spark, df.where(F.lit(False)), [])


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, "other words there")], "doc_id long, text string")
    work = Workspace(spark, "t")
    folder = store.write(df, PATH, 1, work)
    bad = spark.read.parquet(f"{folder}/chunks").withColumn("ids", F.lit(b"\x01\x00")).collect()
    work.save(spark.createDataFrame(bad, "digest binary, ids binary"), "store/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.summary(spark, folder).collect()


def altered(spark, table, column, value):
    """The table with another value in its first row."""
    rows = [r.asDict() for r in table.collect()]
    rows[0][column] = value(rows[0][column])
    return spark.createDataFrame(rows, table.schema)


DAMAGES = {
    "a lost chunk": ("chunks", lambda s, t: t.where(F.col("digest") != t.first().digest)),
    "a lost recipe": ("recipes", lambda s, t: t.where("not (part = 0 and place = 3)")),
    "a lost last recipe": ("recipes", lambda s, t: t.where(F.col("place") < t.agg(F.max("place")).first()[0])),
    "all recipes lost": ("recipes", lambda s, t: t.where("false")),
    "another id": ("recipes", lambda s, t: altered(s, t, "doc_id", lambda v: 10**6)),
    "another length": ("recipes", lambda s, t: altered(s, t, "n_tokens", lambda v: v + 1)),
    "another start": ("recipes", lambda s, t: altered(s, t, "before", lambda v: v + 1)),
    "other ends": ("recipes", lambda s, t: altered(s, t, "ends", lambda v: [v[0] + 1, *v[1:]])),
    "other digests": ("recipes", lambda s, t: altered(s, t, "digests", lambda v: [b"x" * 32, *v[1:]])),
    "another root": ("recipes", lambda s, t: altered(s, t, "root", lambda v: b"x" * 32)),
    "a lost part": ("manifest", lambda s, t: t.where("part > 0")),
    "a part's start": ("manifest", lambda s, t: altered(s, t, "start", lambda v: v + 5)),
    "a part's root": ("manifest", lambda s, t: altered(s, t, "root", lambda v: b"x" * 32)),
    "the head's documents": ("head", lambda s, t: altered(s, t, "documents", lambda v: v - 1)),
    "a lost head": ("head", lambda s, t: t.where("false")),
}


def test_every_loss_and_change_raises(spark, monkeypatch):
    monkeypatch.setattr(store, "PART_ROWS", 8)
    monkeypatch.setattr(store, "FAN", 4)
    rows = [(i, f"document {i} has some words " * (1 + i % 3)) for i in range(30)]
    work = Workspace(spark, "t")
    folder = store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 1, work)
    assert store.summary(spark, folder).count() == 30
    for name, (table, damage) in DAMAGES.items():
        whole = spark.read.parquet(f"{folder}/{table}")
        kept = spark.createDataFrame(whole.collect(), whole.schema)
        work.save(spark.createDataFrame(damage(spark, kept).collect(), whole.schema), f"store/{table}")
        for back in (store.summary, store.read) if table == "chunks" else (store.summary,):
            try:
                back(spark, folder).collect()
            except Exception:
                continue
            raise AssertionError(f"{name} is not noticed by {back.__name__}")
        work.save(kept.coalesce(1), f"store/{table}")
    assert store.summary(spark, folder).count() == 30


def test_wide_ids_are_read_as_they_were_written(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some words here"), (2, "other words there")], "doc_id long, text string")
    folder = store.write(df, PATH, 70_000, Workspace(spark, "t"))
    assert spark.read.parquet(f"{folder}/head").first().width == 4
    assert all(r.ids[-1] == 70_000 for r in store.read(spark, folder).collect())
    assert store.summary(spark, folder).count() == 2


def test_rows_of_one_id_are_split_between_parts(spark, monkeypatch):
    monkeypatch.setattr(store, "PART_ROWS", 50)
    rows = [(None, "the same text") for _ in range(300)] + [(7, f"text {i}") for i in range(300)]
    folder = store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 1, Workspace(spark, "t"))
    sizes = [r.documents for r in spark.read.parquet(f"{folder}/manifest").collect()]
    assert sum(sizes) == 600 and max(sizes) < 200
    got = sorted(store.summary(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(600)]


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_checksums_combine(parts):
    ends = np.cumsum([len(p) for p in parts])
    crc = store.carried(np.array([zlib.crc32(p) for p in parts], np.int64), ends[-1] - ends)
    assert np.bitwise_xor.reduce(crc) == zlib.crc32(b"".join(parts))


@given(st.integers(1, 20_000), st.lists(st.integers(1, 20_000), max_size=50, unique=True))
def test_ends_cover_the_stream(n, places):
    ends = store.ends_of(n, sorted(p for p in places if p <= n))
    assert ends[-1] == n and all(0 < b - a <= store.MOST for a, b in zip([0, *ends], ends))
    assert all(b - a >= store.LEAST for a, b in zip([0, *ends], ends[:-1]))
