import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import nearest

DATA = "/root/testdata"


def brute(ids, x, k=20, every=20):
    x = np.asarray(x, np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def found(df, **kw):
    out = {}
    for r in nearest.nearest(df, **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_order_and_scores(spark, sf, monkeypatch):
    """With candidates pruned: as many cells are searched as the sample tells, and 40 vectors of each block scored exactly."""
    monkeypatch.setattr(nearest, "ROWS", 50)
    monkeypatch.setattr(nearest, "QUERIES", 10)
    monkeypatch.setattr(nearest, "KEPT", 40)
    df = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x)
    whole = found(df, exact=True)
    assert {q: [v for _, v, _ in own] for q, own in whole.items()} == {q: [v for v, _ in own] for q, own in want.items()}
    got = found(df)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    exact = {i: v for i, v in zip(ids, x)}
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s - (exact[q] * exact[v]).sum()) < 1e-12 for _, v, s in own)
        assert [(v, s) for _, v, s in own] == sorted([(v, s) for _, v, s in own], key=lambda p: (-p[1], p[0]))
        assert q not in {v for _, v, _ in own}


def test_ties_copies_and_odd_vectors(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 60)] + [(100, [3.0, 0.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 0.0])]
    rows += [(104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0]), (None, same), (40, same)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, v string").repartition(3)
    got = found(df, k=5)
    assert set(got) == {0, 20, 40, 100}
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [v for _, v, _ in got[40]] == [0, 1, 2, 3, 4]
    assert [v for _, v, _ in got[100]] == [0, 1, 2, 3, 4]
    few = found(df.where("vec_id in (0, 1, 100)"))
    assert [v for _, v, _ in few[0]] == [1, 100] and len(few[100]) == 2
    assert found(df.where(F.lit(False))) == {} and found(df.where("vec_id = 101")) == {}


def test_codes_lower_the_anisotropic_loss():
    x = np.random.default_rng(1).normal(size=(2000, 10)) + 3
    q = nearest.fit(x, 4)
    cell = q.cells(x)
    parts, unit = q.parts(x, cell)

    def loss(codes):
        r = parts - q.centroids[np.arange(codes.shape[1]), codes]
        along = (r * unit).sum((1, 2))
        return ((r**2).sum((1, 2)) + (nearest.ETA - 1) * along**2).mean()

    plain = q.encode(x, cell, sweeps=0)
    assert loss(q.encode(x, cell)) < loss(plain)
    codes = q.encode(x, cell)
    table = q.tables(x[0])
    two = nearest.packed(codes)
    scan = sum(table[j][two[:, j]] for j in range(two.shape[1]))
    near = q.centres[cell] + q.spread[cell][:, None] * q.centroids[np.arange(len(q.centroids)), codes].reshape(len(x), -1)
    assert np.allclose((q.centres @ nearest._pad(x[:1])[0])[cell] + q.spread[cell] * scan, near @ nearest._pad(x[:1])[0], atol=1e-3)
    assert np.linalg.norm(near - nearest._pad(x), axis=1).mean() < 0.5 * np.linalg.norm(x - x.mean(0), axis=1).mean()


def test_groups_of_vectors_are_searched_in_few_cells(spark):
    """Where vectors form groups, a query meets a small part of the cells and still finds its neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.25, size=(4000, 32))
    ids = np.arange(len(x))
    cells = round(len(x) ** 0.5 / 2)
    q = nearest.fit(x, cells)
    sizes = np.bincount(q.cells(x), minlength=cells)
    reach = q.spread * np.sqrt(2 * np.log(sizes + 1.0))
    needed = nearest.cells_needed(q, x, 20, reach)
    assert needed <= cells / 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    assert recall(found(df, probes=needed), brute(ids, x)) >= 0.9


def test_a_block_is_searched_as_by_hand():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[50:60] = x[49]
    q = nearest.fit(x, 1)
    codes = nearest.packed(q.encode(x, q.cells(x)))
    ids, asked = np.arange(300) * 3, np.arange(0, 300, 7)
    for kept in (None, 200):
        got = nearest.search_block(q, ids, codes, x, ids[asked], x[asked], 12, kept)
        hits = 0
        for i, a in enumerate(asked):
            s = (x * x[a]).sum(1)
            want = ids[np.lexsort((ids, -s))[:12]]
            own = got[1][got[0] == ids[a]]
            hits += len(set(own) & set(want))
            if kept is None:
                assert own.tolist() == want.tolist()
        assert hits >= 0.98 * 12 * len(asked)


@pytest.mark.parametrize("noise", [1e-3, 3e-2])
def test_a_third_of_near_copies_is_searched_well(spark, noise):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x[:2000] = x[0] + rng.normal(scale=noise, size=(2000, 64))
    x = rng.permutation(x)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got, want = found(df, every=60), brute(ids, x, every=60)
    assert recall(got, want) >= 0.9
