import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import packing, tokens

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
LIBS = []
for _p in PATHS:
    LIBS.append(Tokenizer.from_file(_p))
    LIBS[-1].encode_special_tokens = True


@pytest.mark.parametrize("which", [0, 1])
@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(alphabet=st.sampled_from("aB's 't1\n\t  \x1c\xa0　\x85é́Σ中!<|endoftext|>"), max_size=50), st.text(max_size=30)))
def test_ids_equal_the_library(which, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    got = np.frombuffer(tokens.ids(PATHS[which]).encode([text])[0], "<u4").tolist()
    assert got == LIBS[which].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", [0, 1])
@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abA1.,  \n'²éİ"), max_size=30))
def test_ids_equal_the_library_around_stops(which, text):
    own = tokens.ids(PATHS[which])
    own.known.clear()
    for _ in range(2):
        got = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert got == LIBS[which].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 20))
def test_fullest_is_the_best_subset(counts, room):
    used = packing.fullest(counts, room)
    assert all(k <= counts[x] for x, k in used.items())
    best = max(
        s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(x * k for x, k in zip(counts, c))) <= room
    )
    assert sum(x * k for x, k in used.items()) == best


def test_plan_takes_each_piece_once_and_is_tight():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        x = min(1024, int(rng.lognormvariate(5.5, 1)) + 1)
        counts[x] = counts.get(x, 0) + 1
    found = packing.plan(counts)
    taken = {}
    for times, used in found:
        assert 0 < sum(x * k for x, k in used.items()) <= 1024
        for x, k in used.items():
            taken[x] = taken.get(x, 0) + k * times
    assert taken == counts
    assert sum(t for t, _ in found) <= -(-sum(x * k for x, k in counts.items()) // 1024) + 1


def check(rows, docs, capacity):
    lib = LIBS[0]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    want_rows = 0
    for d, texts in docs.items():
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
        want = []
        for t in texts:
            ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
            raw = np.array(ids, "<u4").tobytes()
            want += [(p, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        assert got == sorted(want)
        want_rows += len(want)
    assert len(rows) == want_rows
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(bins), total


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    docs = {r.doc_id: [r.text] for r in df.collect()}
    bins, total = check(packing.pack(df, PATHS[0]).collect(), docs, 1024)
    assert bins <= 1.02 * total / 1024


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "a b", 6), (2, "a b", 6), (3, "word " * 3000, 0)] + [(9, "same text here", 1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    docs = {}
    for d, t, _ in rows:
        docs.setdefault(d, []).append(t)
    check(packing.pack(df, PATHS[0]).collect(), docs, 1024)
    check(packing.pack(df, PATHS[0], capacity=7).collect(), docs, 7)
    assert packing.pack(df.where(F.lit(False)), PATHS[0]).collect() == []
