import random
from itertools import combinations

import corpus_pipeline
import numpy as np

from weft.llm import copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, radius=copies.RADIUS):
    """Ids of one document a group, by all pairs: alike by 0.8, and by ``radius`` bits of the words' SimHash."""

    def cut(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [cut(t) for _, t in rows]
    values = [simhash.word_fingerprint(t.encode().lower().split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            near += sets[a] != sets[b]
            if (values[a] ^ values[b]).bit_count() > radius and sets[a] != sets[b]:
                continue
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}, near


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    rows = []
    for base in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 200, 600]))]
        rows.append(words)
        for _ in range(rng.choice([0, 1, 4])):
            own = list(words)
            for _ in range(max(1, len(own) // rng.choice([40, 60, 90, 20]))):
                own[rng.randrange(len(own))] = "edit%d" % rng.randrange(100)
            rows.append(own)
    chain = [f"c{i}" for i in range(300)]  # each a near copy of its neighbours only
    for i in range(12):
        rows.append([f"x{j}" if j < 12 * i else w for j, w in enumerate(chain)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want, near = brute(rows)
    assert near > 20 and len(want) < len(rows)
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.distinct_documents(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_one_row_of_repeated_and_nameless_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (4, "one two"), (4, "one two"), (7, ""), (6, None), (3, "ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in copies.one_per_group(docs).collect()) == [(0, "a b"), (3, "ONE two"), (6, None)]
    assert copies.one_per_group(docs.where("false")).collect() == []


def test_most_near_copies_of_the_documents_are_within_the_radius(spark):
    """Of sf0.1's pairs alike by 0.8 with different shingle sets, the covering tables reach at least nine in ten."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    texts = {r.text or "" for r in rows}
    by_shingle, sets = {}, []
    for t in texts:
        own = copies.shingles(t)
        sets.append((own, simhash.word_fingerprint(copies.words(t))))
        # two sets alike by 0.8 share one of the smallest fifth of their shingles, and one more
        for s in own[: len(own) - -(-len(own) * 4 // 5) + 1].tolist():
            by_shingle.setdefault(s, []).append(len(sets) - 1)
    pairs = {p for same in by_shingle.values() for p in combinations(same, 2)}
    near = [(a, b) for a, b in pairs if 0.8 <= copies.jaccard(sets[a][0], sets[b][0]) < 1]
    found = [(a, b) for a, b in near if (sets[a][1] ^ sets[b][1]).bit_count() <= copies.RADIUS]
    assert len(near) > 20 and len(found) >= 0.9 * len(near), (len(found), len(near))


def test_buckets_of_unlike_values_stay_small():
    """No covering mask of the stage is of a few bits: one of a single bit put half of all nodes in one bucket."""
    masks = simhash.masks(simhash.BITS, copies.RADIUS)
    assert len(set(masks)) == (1 << copies.RADIUS + 1) - 1
    assert min(m.bit_count() for m in masks) >= simhash.BITS // 2


def test_masks_cover_every_difference_of_six_bits():
    rng = random.Random(8)
    masks = simhash.masks(simhash.BITS, copies.RADIUS)
    for _ in range(20_000):
        apart = sum(1 << b for b in rng.sample(range(simhash.BITS), copies.RADIUS))
        assert any(not m & apart for m in masks)


def test_sketches_lose_no_alike_pair(spark):
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for n in (1, 4, 5, 8, 9, 63, 64, 65, 120, 128, 129, 500, 1030, 90_000):
        for away in (0, n // 9, n // 9 + 1, n // 5, n // 2, n):
            for more in (0, n // 8, n // 4):
                a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
                b = np.unique(np.concatenate([a[away:], rng.integers(0, 1 << 64, max(1 if away == n else 0, more), np.uint64)]))
                for s in (a, b):
                    rows.append((len(rows), len(rows), len(s), copies.sketch(s).tolist(), bytearray(s.tobytes())))
                pairs.append((len(rows) - 2, len(rows) - 1, copies.jaccard(a, b) >= copies.LEAST))
    # pairs that meet are within a quarter in size
    size = {r[0]: r[2] for r in rows}
    pairs = [p for p in pairs if min(size[p[0]], size[p[1]]) >= copies.LEAST * max(size[p[0]], size[p[1]])]
    table = spark.createDataFrame(rows, "row long, node long, n int, sketch array<long>, own binary")
    asked = spark.createDataFrame([p[:2] for p in pairs], "u long, v long")
    found = {(r.u, r.v) for r in copies.perhaps_alike(asked, table).collect()}
    want = {p[:2] for p in pairs if p[2]}
    assert want <= found and len(want) > 60
    assert {(r.u, r.v) for r in copies.alike(asked, table).collect()} == want
    # unlike sets of some size go
    assert all(copies.jaccard(*(np.frombuffer(bytes(rows[i][4]), np.uint64) for i in p)) > 0.5 for p in found if size[p[0]] >= 64 and size[p[0]] < 5000)


def test_pairs_of_a_large_group_are_not_listed(spark, monkeypatch):
    """Texts within six bits of each other and mostly less alike than 0.8: pairs were written before sketches were compared."""
    rng = random.Random(11)
    base, rows = [f"b{i}" for i in range(300)], []
    for edits in [1] * 10 + [8] * 110:
        own = list(base)
        for at in rng.sample(range(300), edits):
            own[at] = "edit%d" % rng.randrange(10_000)
        rows.append((len(rows), " ".join(own)))
    values = [simhash.word_fingerprint(copies.words(t)) for _, t in rows]
    met = sum((a ^ b).bit_count() <= copies.RADIUS for a, b in combinations(values, 2))
    written, save = [], copies.Workspace.save

    def counted(work, df, name, *more):
        out = save(work, df, name, *more)
        if {"u", "v"} <= set(out.columns) and not name.startswith("cc"):
            written.append(out.count())
        return out

    monkeypatch.setattr(copies.Workspace, "save", counted)
    kept = copies.one_per_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in kept} == brute(rows)[0] and 1 < len(kept) < len(rows)
    assert met > 1000 and sum(written) < 5 * len(rows), (met, written)
