"""The end-to-end plan: records to id lists, in one job of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as S
from weft.functions import text as X
from weft.operators import blocking, decide
from weft.sources import sinks


def word_keys(words: Column) -> dict[str, Column]:
    """Words of at least four characters, numbers with their next word, and the sorted words as one key."""
    return {
        "w": F.filter(words, lambda t: F.length(t) >= 4),
        "b": blocking.bigram_keys(words),
    }


def link(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str = "words", share: float = 2e-4, k: int = 5,
    least: float = 0.2, most: int = 10, label: str = "cty",
) -> DataFrame:
    """Id lists of the left records: capped keys, index join, word likeness, exclusivity, threshold."""
    totals = right.groupBy(label).agg(F.count("*").alias("n"))
    asked = blocking.keys(left, left_id, word_keys(F.col(words)), label)
    posted = blocking.postings(blocking.keys(right, right_id, word_keys(F.col(words)), label), totals, share, 20, label)
    found = blocking.index_join(asked, posted, k, left_id, right_id, label)
    a = left.select(label, left_id, F.array_distinct(words).alias("wa"))
    b = right.select(label, right_id, F.array_distinct(words).alias("wb"))
    scored = found.join(a, [label, left_id]).join(b, [label, right_id]).withColumn("p", F.round(S.jaccard(F.col("wa"), F.col("wb")), 6))
    own = decide.exclusive(scored.select(left_id, right_id, "p"), left=left_id, right=right_id)
    matched = decide.threshold(own, least, most, left_id, right_id)
    return sinks.id_lists(matched, left, left_id, left_id, right_id, "matched")


def documents_to_benchmark(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Benchmark items as reference records, documents as noisy ones: which documents mostly repeat which item."""
    left = items.select("item_id", F.lit("all").alias("cty"), X.ascii_words(F.coalesce("text", F.lit(""))).alias("words"))
    right = docs.select("doc_id", F.lit("all").alias("cty"), X.ascii_words(F.coalesce("text", F.lit(""))).alias("words"))
    return link(left, right, "item_id", "doc_id", share=5e-3, k=20, least=0.05)
