import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = pieces.codec(PATH)


def same(text):
    want = LIB.encode(text, add_eos=True)
    assert [*OWN.encode(text), OWN.end] == want
    assert OWN.decode(want) == LIB.decode(want)
    n, ids, back = OWN.both(text)
    assert (n, ids, back) == (len(want), " ".join(map(str, want)), LIB.decode(want))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeinrst  \n\t.,'!1234éüß▁中文ㅎ😀<>0x́​"), max_size=60))
def test_equals_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_equals_the_library_on_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    same(text)


@pytest.mark.parametrize(
    "text", ["", " ", "   ", "\n", " \n ", "<s>a</s>", "<0x41>", "a" * 5000, "ab" * 3000 + " " * 700, "\x00x", "▁", " ▁ a", "aaaa  bbbb"]
)
def test_odd_texts(text):
    same(text)


def test_long_random_words():
    rng = random.Random(1)
    for _ in range(60):
        same("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 400))))


def test_other_models_are_refused():
    with pytest.raises((ValueError, KeyError)):
        pieces.Codec(b"")


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pieces.digests(rows, PATH).collect()}
    full = {r.doc_id: r for r in pieces.encode(rows, PATH).collect()}
    for r in rows.collect():
        want = LIB.encode(r.text, add_eos=True)
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIB.decode(want).encode()).hexdigest()
        assert list(full[r.doc_id].ids) == want and full[r.doc_id].decoded == LIB.decode(want)


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "a", 0), (2, "a", 0)], "doc_id long, text string, ids int")
    rows = pieces.digests(df, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (1, 1), (2, 2), (2, 2)]
    assert pieces.digests(df.where(F.lit(False)), PATH).collect() == []
