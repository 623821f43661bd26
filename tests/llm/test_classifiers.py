import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"


def test_indicators_are_the_ngrams_of_the_whole_text(monkeypatch):
    text = "abcé " * 700 + "zz"
    whole = quality.indicators(text)
    monkeypatch.setattr(quality, "BLOCK", 64)
    assert np.array_equal(quality.indicators(text), whole)
    assert len(quality.indicators("")) == 0
    assert len(quality.indicators("a")) == 1


def test_svm_separates_and_keeps_the_dual_bounds():
    rng = random.Random(1)
    good = ["".join(rng.choice("abcdef ") for _ in range(80)) for _ in range(60)]
    bad = ["".join(rng.choice("abcdef $%") for _ in range(80)) for _ in range(30)]
    rows = [quality.indicators(t) for t in good + bad]
    y = np.array([1] * 60 + [0] * 30)
    model = quality.fit(rows, y, 2 / 3)
    scores = np.array([model.score(x) for x in rows])
    assert scores[:60].min() > scores[60:].max()
    assert ((scores >= 0.5) == (y == 1)).all()
    assert 0 <= model.score_text("") <= 1 and 0 <= model.score_text("a " * 100_000) <= 1


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.95)])
def test_documents(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    want = {r.doc_id: r[label] for r in labels.collect()}
    own = [(r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    assert sum(a == b for a, b in own) / len(own) >= least
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(abs(model.score_text(texts[r.doc_id]) - r.score) < 1e-12 for r in rows)


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_tables(spark, module):
    docs = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "x" * 300_000, 9), (2, "a", 9)], "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = module.score(docs, module.train(docs, none)).collect()
    assert len(rows) == 4 and all(r.score == 0.5 for r in rows)
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 9)] + [(None, 0, 0), (3, None, None)], none.schema)
    assert all(r.score > 0.9 for r in module.score(docs, module.train(docs, one)).collect())
    assert module.score(docs.where(F.lit(False)), module.train(docs, one)).collect() == []


def test_lexicon_folds_shields_and_normalises():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "clown": 3.0}, toxicity.PHRASES, 1.0, -1.0)
    entries = [m[1] for m in lexicon.matches(toxicity.fold("Id10t іdiоt! a clown fish CLOWNS xidiot"))]
    assert entries == ["idiot", "idiot", "clown"]
    assert lexicon.strength("idiot") > lexicon.strength("idiot " + "word " * 500) > 0
    assert lexicon.strength("idiot idiot") <= lexicon.strength("idiot")
    assert lexicon.strength("") == lexicon.strength("a clown fish") == 0


def test_choose_prefers_exact_beginnings():
    counts = {"idio": (50, 0), "idiot": (50, 0), "idioti": (9, 0), "vequ": (60, 1), "vequa": (20, 0), "them": (50, 50)}
    assert set(toxicity.choose(counts, 100, 100)) == {"idiot", "vequ"}


def test_keep_leaves_columns(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()} == {r.doc_id for r in docs.collect()} - bad


@pytest.mark.parametrize("module", [quality, toxicity])
def test_the_model_does_not_depend_on_partitions(spark, module):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    # repeated ids with other texts, and labels that contradict each other
    docs = docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.reverse("text").alias("text")).where("doc_id % 3 = 0"))
    labels = labels.unionByName(labels.where("doc_id % 5 = 1").withColumn("quality", F.lit(0)).withColumn("toxic", F.lit(1)))
    models = [module.train(docs.repartition(n), labels.repartition(n)) for n in (1, 3, 8)]
    texts = [r.text for r in docs.limit(50).collect()]
    for other in models[1:]:
        assert [models[0].score_text(t) for t in texts] == [other.score_text(t) for t in texts]
    if module is toxicity:
        assert models[0] == models[1] == models[2]


def test_coordinate_descent_reaches_the_optimum_of_a_plain_solver():
    """The hinge loss of the fit is within the gap of the best that projected gradient ascent on the dual finds."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(12)) for _ in range(40)]
    y = np.array([int(rng.random() < 0.3 + 0.5 * ("ab" in t)) for t in texts])
    rows = [quality.indicators(t) for t in texts]
    model = quality.fit(rows, y, y.mean())
    on = np.unique(np.concatenate(rows))
    ratio = model.ratio[on].astype(np.float64)
    x = np.array([[ratio[i] if f in set(r.tolist()) else 0.0 for i, f in enumerate(on)] + [1.0] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    sign = np.where(y > 0, 1.0, -1.0)

    def primal(w):
        return 0.5 * w @ w + quality.COST * np.maximum(1 - sign * (x @ w), 0).sum()

    gram = (x * sign[:, None]) @ (x * sign[:, None]).T
    dual = np.zeros(len(y))
    for _ in range(20_000):
        dual = np.clip(dual + 0.02 * (1 - gram @ dual), 0, quality.COST)
    best = primal(x.T @ (dual * sign))
    own = primal(np.append(model.weights[on] / np.where(ratio == 0, 1, ratio), model.bias))
    assert best * 0.999 <= own <= best * (1 + 2 * quality.GAP)


def test_matches_are_those_of_a_naive_search():
    rng = random.Random(8)
    entries = {"abc": 1.0, "abca": 2.0, "bca": 1.5, "caaab": 3.0}
    lexicon = toxicity.Lexicon(entries, ("abc abc", "bca c"), 1.0, 0.0)
    for _ in range(300):
        text = "".join(rng.choice("abc  ") for _ in range(40))
        starts = [i for i in range(len(text)) if not i or not text[i - 1].isalnum()]
        shields = [(i, i + len(p) - 1) for p in lexicon.phrases for i in starts if text.startswith(p, i)]
        want = sorted((i, e) for e in entries for i in starts if text.startswith(e, i) and not any(a <= i <= b for a, b in shields))
        assert sorted((at, e) for at, e, _ in lexicon.matches(text)) == want
