import random
from itertools import combinations

import xxhash
from pyspark.sql import types as T

from weft.llm import simhash
from weft.llm.common import Workspace, connected_components

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())]
)


def brute(rows):
    def fp(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not words:
            return 0
        sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            parent[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, f"{fps[i]:016x}", min(groups[find(i)])) for i, (d, _) in enumerate(rows))


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], DOCS)
    return sorted(tuple(r) for r in simhash.near_duplicates(df).collect())


def test_covering_masks_meet_every_pair_within_two_bits():
    ms = simhash.masks()
    assert len(ms) == 7
    for i, j in combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in ms)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["Ab", "cd", "EF", "gh\t", "é", "x\ny", "zz"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 30])))) for i in range(120)]
    base = " ".join(rng.choice(vocab) + str(rng.randrange(60)) for _ in range(300))
    for i in range(120, 200):
        words = base.split()
        words[rng.randrange(len(words))] = "new"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, " "), (203, " "), (204, "x " * 200_000)]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert result(spark, []) == []
    got = spark.createDataFrame([(None, "a b c d", ""), (7, "a b c d", ""), (None, "q", "")], DOCS)
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(got).collect()}
    assert rows == {(None, 7), (7, 7), (None, None)}


def test_links_join_exactly_the_pairs_within_two_bits(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centre)
    for c in centre:
        for _ in range(120):
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) << rng.randrange(64))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = connected_components(simhash.links(df), Workspace(spark, "t")).collect()
    label = {r.node: r.root for r in got}
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, sa), (b, sb) in combinations(list(zip(fps, signed)), 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(sa)] = find(sb)
    want = {}
    for s in signed:
        want.setdefault(find(s), []).append(s)
    for s in signed:
        assert label.get(s, s) == min(want[find(s)])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 8), (900, 901)], "u long, v long")
    got = {(r.node, r.root) for r in connected_components(edges, Workspace(spark, "t")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(900, 900), (901, 900)}


def test_wide_radius_tables_meet_with_certainty(spark):
    """Every value within the radius of the stage shares a key, and the keys are those of the masks."""
    import random

    from weft.llm import copies

    rng = random.Random(3)
    rows = []
    for i in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(copies.RADIUS + 1)):
            b ^= 1 << bit
        rows += [(i, 0, a - (1 << 64) if a >> 63 else a), (i, 1, b - (1 << 64) if b >> 63 else b)]
    df = spark.createDataFrame(rows, "i long, side int, fp long")
    keys = df.select("i", "side", simhash.covered(df.fp, copies.RADIUS).alias("k")).collect()
    of = {(r.i, r.side): set(r.k) for r in keys}
    assert all(len(k) == 2 ** (copies.RADIUS + 1) - 1 for k in of.values())
    assert all(of[i, 0] & of[i, 1] for i in range(60))


def test_word_fingerprint_counts_capped_words():
    import xxhash

    words = [b"a"] * 9 + [b"b"] * 2 + [b"c"]
    want = 0
    for bit in range(64):
        on = sum(k for w, k in ((b"a", 4), (b"b", 2), (b"c", 1)) if xxhash.xxh64_intdigest(w, 42) >> bit & 1)
        want |= (on * 2 > 7) << bit
    assert simhash.word_fingerprint(words) == want
    assert simhash.word_fingerprint([]) == 0
