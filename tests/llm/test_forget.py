"""Workers give back what they remembered for one stage when they serve another."""

import os
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import common, copies, packing, pieces, tokens


def test_forget_empties_what_is_remembered():
    tokens.ids(public_tokenizers.path("byte_bpe_50k.json"), 10)
    pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    common.forget()
    assert tokens.ids.cache_info().currsize == pieces.codec.cache_info().currsize == 0


def test_later_stage_of_a_worker(spark):
    """A worker that packed kept its tokenizer and its cuts through all later stages."""
    path = public_tokenizers.path("byte_bpe_50k.json")

    def run(fill: bool):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                pass
            if fill:
                tokens.ids(path, 1000)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([tokens.ids.cache_info().currsize])], names=["pid", "n"])

        return [tuple(r) for r in spark.range(1).coalesce(1).mapInArrow(own, "pid long, n long").collect()]

    filled = {run(True)[0][0] for _ in range(4)}
    docs = spark.range(8).repartition(1).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    for _ in range(12):
        copies.signatures(docs, "doc_id", "text").collect()
    after = [run(False)[0] for _ in range(12)]
    seen = [n for pid, n in after if pid in filled]
    if not seen:
        pytest.skip("the workers were not used again")
    assert not any(seen)


def test_packing_by_small_groups(spark):
    """The pipeline looks up fewer texts together than the operator alone: the same pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    few, many = (sorted(map(tuple, packing.pieces(docs, path, 2, kept=100, size=n).drop("rank", "task").collect())) for n in (10_000, 9_000_000))
    assert few == many and few
