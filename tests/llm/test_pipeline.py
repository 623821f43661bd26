import corpus_pipeline

from weft.llm import quality, toxicity
from tests.llm.test_copies import brute

DIR = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    rows, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, DIR)
        assert kept.schema.names == docs.schema.names
        rows = spark.createDataFrame(kept.collect(), docs.schema)
        seen.append({r.doc_id: r.text for r in rows.collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels)
    assert set(seen[0]) == {d for d, t in texts.items() if model.score_text(t) >= quality.KEEP_FROM}
    first = spark.createDataFrame([(d, t) for d, t in seen[0].items()], "doc_id long, text string")
    lexicon = toxicity.train(first, labels)
    assert set(seen[1]) == {d for d, t in seen[0].items() if lexicon.score_text(t) < toxicity.TOXIC_FROM}
    assert set(seen[2]) == brute(sorted((d, t or "") for d, t in seen[1].items()))[0]
    packed = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in packed} == set(seen[2])
    bins = {}
    for r in packed:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 1024


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, y int"
    rows = [
        (1, None, None, None, None, "c", 1), (None, "Plain words of a text that stays.", "en", "s", 3, None, None), (2, "", "en", "s", 0, "c", 2),
        (3, "one two three four five " * 30_000, "en", "s", 5, "c", 2), (4, "one two", "en", "s", 7, "c", 2), (4, "one two", "en", "s", 7, "c", 2),
    ]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.schema.names == docs.schema.names, name
        own = kept.collect()
        assert {r.doc_id for r in own} <= {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.where("false"), DIR).collect() == []
    assert len(corpus_pipeline.STAGES[2][1](spark, docs, DIR).where("doc_id = 4").collect()) == 1
    packed = corpus_pipeline.STAGES[3][1](spark, docs, DIR).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 4}
    assert corpus_pipeline.STAGES[3][1](spark, docs.where("false"), DIR).collect() == []
