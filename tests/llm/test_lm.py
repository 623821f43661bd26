import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import lm


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def check(spark, df, rows):
    got = lm.score(df).collect()
    assert len(got) == len(rows)
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        want[d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    return got


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(spark, df.repartition(3), [(r.doc_id, r.text) for r in df.collect()])
    training = [r for r in got if not r.held_out]
    known = [r for r in got if r.held_out and r.n_known == r.n_tokens]  # where the base is a probability
    for own in (training, known):
        assert sum(r.n_tokens for r in own) > 500
        model, base = (sum(r[c] for r in own) / sum(r.n_tokens for r in own) for c in ("score", "base_score"))
        assert model > base + 0.1
    seen = {r.held_out: r for r in lm.perplexity(lm.score(df)).collect()}
    assert seen[True].perplexity < seen[True].base_perplexity


def test_small_blocks_and_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Aa aA aa\x0bé"), (4, "Aa aA aa\x0bé"), (5, "new" * 40_000), (10, "x " * 50_000)]
    rows += [(100 + i, f"the cat {i} sat on the mat") for i in range(60)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, words int").repartition(3)
    whole = {(r.doc_id, r.n_tokens): r.score for r in check(spark, df, rows)}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1)
    monkeypatch.setattr(lm, "FAN", 2)  # blocks of a batch, three levels of merging
    monkeypatch.setattr(lm, "SHARD_BYTES", 30_000)
    for r in check(spark, df.repartition(7), rows):
        assert abs(whole[r.doc_id, r.n_tokens] - r.score) < 1e-4 * abs(r.score)
    nobody = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    for r in lm.score(nobody).collect():
        assert r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0
    assert lm.score(df.where(F.lit(False))).collect() == []
    assert lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().n_tokens == 3


def test_the_result_does_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.score for r in lm.score(df.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm.score(df.repartition(7)).collect()}
    assert all(abs(one[d] - many[d]) < 1e-6 for d in one)


def test_byte_probabilities_add_up():
    text = pa.array([b"the", b"then", b"a", b"\xc3\xa9t\xc3\xa9", lm.END], pa.binary())
    symbols, contexts, ends = lm.spelled(text)
    assert ends.tolist() == [4, 9, 11, 17, 18]
    assert contexts[:3].tolist() == [0x2020, 0x2000 | ord("t"), ord("t") << 8 | ord("h")]
    cells, n = np.unique(contexts << 8 | symbols, return_counts=True)
    model = lm.byte_model(cells, n * 50, 1)
    assert np.allclose(model.table.sum(1), 1)
    logs = model.words(pa.array([b"the", b"zq"], pa.binary()))
    assert logs[0] > logs[1]


def top_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cells = lm.parsed(df, "doc_id", "text", 1).where("kind = 1").withColumn("node", F.lit(0).cast("long"))
    return lm.merged(cells.select("shard", "node", "words", "sizes", "contexts", "customers"))


def test_probabilities_after_a_context_add_up(spark):
    rows = [(i, "ab ab ba a " + "ab ba " * (i % 3)) for i in range(1, 30)] + [(100, "never a ab")]
    top = top_of(spark, rows)
    model = lm.train(top)
    cells = lm.Cells.of(**top.select("words", "sizes", "contexts", "customers").first().asDict())
    assert model.tokens == cells.c.sum() == sum(len(words(t)) for d, t in rows if not held(d))
    for s, (tables, customers, word_tables) in enumerate(cells.sweeps(model, lm.BURN + lm.SAMPLES)):
        assert ((tables >= 1) == (cells.c >= 1)).all() and (tables <= cells.c).all() and (word_tables <= customers).all()
        assert np.array_equal(np.bincount(cells.context, tables, len(model.customers)), model.tables[s])
        base = cells.base(model, s, customers, word_tables)
        spelled = np.exp(model.byte_models[s].words(cells.words)).sum()
        rest = (1 + model.word_discount * model.word_tables[s]) / (1 + model.word_customers[s])
        assert abs(base.sum() + rest * (1 - spelled) - 1) < 1e-5
        for context in np.unique(cells.context):
            own = (cells.c - model.context_discount * tables)[cells.context == context].sum()
            passed = 1 + model.context_discount * model.tables[s][context]
            assert abs((own + passed) / (1 + model.customers[context]) - 1) < 1e-9


def test_a_sequential_sampler_agrees(spark):
    """A plain Gibbs sampler, one customer at a time, with the same discounts and spelling gives about the same probabilities."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(1, 60):
        text = [rng.choice(vocabulary)]
        for _ in range(14):
            text.append(vocabulary[(vocabulary.index(text[-1]) * 5 + rng.choice([1, 1, 1, 2, 7])) % 12])
        rows.append((i, " ".join(text)))
    top = top_of(spark, rows)
    model = lm.train(top)
    cells = lm.Cells.of(**top.select("words", "sizes", "contexts", "customers").first().asDict())
    price = 10 ** cells.log10(model)
    spelling = np.exp(model.byte_models[-1].words(cells.words))
    d1, d2, n_words = model.word_discount, model.context_discount, len(cells.words)
    seats = {k: [] for k in range(len(cells.c))}  # tables' sizes of each cell, and of each word in the parent
    parents = {w: [] for w in range(n_words)}
    total, sampler = {}, random.Random(9)

    def base(w):
        n, t = sum(map(sum, parents.values())), sum(map(len, parents.values()))
        return (sum(parents[w]) - d1 * len(parents[w]) + (1 + d1 * t) * spelling[w]) / (1 + n)

    def sit(tables, discount, new):
        x = sampler.random() * (sum(n - discount for n in tables) + new)
        for i, n in enumerate(tables):
            x -= n - discount
            if x < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        i = sampler.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    def tables_in(k):
        return sum(len(seats[j]) for j in np.flatnonzero(cells.context == cells.context[k]))

    for sweep in range(14):
        for k in range(len(cells.c)):
            w = cells.word[k]
            for _ in range(cells.c[k]):
                if sweep and leave(seats[k]):
                    leave(parents[w])
                if sit(seats[k], d2, (1 + d2 * tables_in(k)) * base(w)):
                    sit(parents[w], d1, (1 + d1 * sum(map(len, parents.values()))) * spelling[w])
        if sweep >= 4:
            for k in range(len(cells.c)):
                p = (cells.c[k] - d2 * len(seats[k]) + (1 + d2 * tables_in(k)) * base(cells.word[k])) / (1 + model.customers[cells.context[k]])
                total[k] = total.get(k, 0) + p / 10
    want = np.array([total[k] for k in range(len(cells.c))])
    often = cells.c >= 5
    assert often.sum() > 10
    assert np.abs(np.log10(price[often] / want[often])).mean() < 0.02
    assert np.abs(np.log10(price / want)).mean() < 0.1


def test_seating_follows_the_restaurant():
    n = 4000
    c = np.full(n, 30)
    pull, d = np.full(n, 0.7), 0.4
    mean = lm.seat(c, pull, d, np.arange(n) * 7919, 3).mean()
    rng, total = np.random.default_rng(0), 0
    for _ in range(3000):
        t = 1
        for i in range(1, 30):
            t += rng.random() < 0.7 / (0.7 + i - d * t)
        total += t
    assert abs(mean - total / 3000) < 0.1
    large = lm.seat(np.array([10**7, 5, 0, 1]), np.full(4, 0.5), 0.5, np.arange(4), 1)
    assert 1 <= large[0] < 10**5 and large[2] == 0 and large[3] == 1
