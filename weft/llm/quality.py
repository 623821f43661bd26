"""Quality classifier: a linear support vector machine on Naive Bayes features.

The indicators of the hashed byte n-grams (lengths 1 to 4) of a whole text,
and of the n-grams of whether a word equals the one before, are scaled by their class log-count ratios and normalised; a hinge-loss
model is fitted to them by dual coordinate descent, and its margins are
turned into probabilities by a logistic curve fitted to the training rows.

Fitted on at most ``MOST_ROWS`` labelled rows a class, with the class prior
of all training labels. Only the text is an input of a score.

Edge cases: null text counts as empty and gets the score of a text without
n-grams; without training rows of both classes every score is the share of
label 1 (one half if there are no labels); repeated rows and null ids are
scored like any other; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bounded_batches, fold_of, forget
from weft.llm.labelled import training_rows

BITS = 18
LENGTHS = 4
#: Labelled rows of each class that the model is fitted on.
MOST_ROWS = 2000
COST = 1.0
#: Coordinate descent ends at this gap between primal and dual, relative to the primal, or after so many passes.
GAP, EPOCHS = 0.01, 60
KEEP_FROM = 0.3
#: Bytes hashed at once, with an overlap: memory does not grow with a text.
BLOCK = 1 << 20


def indicators(text: str) -> np.ndarray:
    """Sorted numbers of the hashed n-grams that occur."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, len(data), BLOCK):
        b = data[at : at + BLOCK + LENGTHS - 1].astype(np.uint32)
        h = b
        seen[b] = True
        for k in range(2, LENGTHS + 1):
            if len(b) < k:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ b[k - 1 :]
            seen[(h * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words = text.split()
    if len(words) > 1:
        same = np.fromiter(map(str.__eq__, words, words[1:]), bool, len(words) - 1).astype(np.uint32)
        h = same + 2
        for k in range(1, LENGTHS + 1):
            if k > 1:
                h = h[:-1] * np.uint32(2) + same[k - 1 :]
            seen[256 + np.unique(h)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """weights: of the scaled indicators, already times their ratio; ratio: for the norm."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def score_text(self, text: str) -> float:
        return self.score(indicators(text))

    def score(self, found: np.ndarray) -> float:
        norm = np.sqrt((self.ratio[found].astype(np.float64) ** 2).sum() + 1.0)
        margin = (self.weights[found].astype(np.float64).sum() + self.bias) / norm
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method on Platt's smoothed targets."""
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        w, g = p * (1 - p) + 1e-9, p - target
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * margin).sum() + 1e-3 * a, g.sum()])
        size = np.abs(step).max()
        step *= min(1.0, 5.0 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """The model of indicator rows and their 0/1 labels; ``share`` of label 1 among all."""
    size = 1 << BITS
    if not 0 < y.sum() < len(y):
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6))
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(odds))
    good, bad = np.ones(size), np.ones(size)
    for x, label in zip(rows, y, strict=True):
        (good if label else bad)[x] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    norm = [np.sqrt((ratio[x] ** 2).sum() + 1.0) for x in rows]
    scaled = [(ratio[x] / n).astype(np.float32) for x, n in zip(rows, norm, strict=True)]
    sign = np.where(y > 0, 1.0, -1.0)
    w, bias, dual = np.zeros(size), 0.0, np.zeros(len(y))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            x, v, one = rows[i], scaled[i], 1 / norm[i]
            slack = sign[i] * (w[x] @ v + bias * one) - 1
            new = min(max(dual[i] - slack / (v @ v + one * one), 0.0), COST)
            if (step := (new - dual[i]) * sign[i]) != 0:
                w[x] += step * v
                bias += step * one
                dual[i] = new
        margin = np.array([(w[x] @ v) + bias / n for x, v, n in zip(rows, scaled, norm, strict=True)])
        half = 0.5 * (w @ w + bias * bias)
        primal = half + COST * np.maximum(1 - sign * margin, 0).sum()
        if primal - (dual.sum() - half) <= GAP * primal:
            break
    margin = np.array([(w[x] @ v) + bias / n for x, v, n in zip(rows, scaled, norm, strict=True)])
    slope, shift = _curve(margin, y)
    prior = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6))
    shift += prior - np.log(y.sum() / (len(y) - y.sum()))
    return Model((w * ratio).astype(np.float32), ratio.astype(np.float32), bias, slope, float(shift))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    bounded_batches(docs.sparkSession)
    sample, share = training_rows(docs, labels, label, 5, MOST_ROWS, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [indicators(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "y", "x"]
            )

    kind = sample.schema["id"].dataType.simpleString()
    # at most 2 * MOST_ROWS documents' indicators
    rows = sample.mapInArrow(run, f"id {kind}, y int, x binary").collect()
    rows.sort(key=lambda r: r["id"])
    return fit([np.frombuffer(r["x"], np.int32) for r in rows], np.array([r["y"] for r in rows], np.int64), share)


def score(
    docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS weights and ratios: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = shared.value
        for batch in batches:
            scores = [own.score_text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, score double").select(
        id_col,
        (fold_of(F.col(id_col), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= keep_from).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good, columns unchanged."""
    return keep(docs, train(docs, labels, "quality", id_col, text_col), text_col, lambda s: s >= KEEP_FROM)


def keep(docs: DataFrame, model, text_col: str, wanted) -> DataFrame:
    """Rows whose score is wanted: texts are scored where they are, no join."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([wanted(own.score_text(t.as_py() or "")) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
