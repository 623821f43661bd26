"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, look-alike letters, digits that
stand for letters) and the lexicon's entries are matched by one Aho-Corasick
automaton at word starts, except inside an exception phrase. The weights of
the matches, over the logarithm of the number of words, give a score by a
logistic curve.

Entries are word beginnings of ``SHORTEST`` to ``LONGEST`` letters, learned
from at most ``MOST_ROWS`` labelled rows a class by their log-odds between
toxic and other documents; an entry must occur in at least ``SUPPORT`` of
the toxic ones. Word pairs around an entry that occur only in documents not
labelled toxic are learned as exception phrases, beside the fixed ones.
Equal texts of a class count once. The fixed phrases are common harmless
ones, an argument of ``train``. The fit does not depend on partitions: the
sample is written once, and all choices are made in a total order.

Edge cases: null text counts as empty and scores as a text without matches;
without training rows of both classes there is no entry and every score is
the share of label 1 (one half if there are no labels); repeated rows and
null ids are scored like any other; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import quality
from weft.llm.common import bounded_batches, forget
from weft.llm.labelled import training_rows

#: Labelled rows of each class that the lexicon is learned from.
MOST_ROWS = 4000
SHORTEST, LONGEST = 4, 12
SUPPORT, LEAST_DOCUMENTS = 0.01, 8
#: Least log-odds of an entry.
LEAST_WEIGHT = 3.0
TOXIC_FROM = 0.5

# Look-alike letters, digits and signs for letters, harmless phrases.
LOOK_ALIKE = "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ӏl ԛq ԝw кk мm тt вb нh αa εe οo ρp ιi κk νv τt υu ηn ωw ıi ɑa ɡg ℓl"
SIGNS = "0o 1i 3e 4a 5s 7t 8b @a $s"
PHRASES = ("clown fish", "clownfish", "trash can", "trash bin", "idiot proof", "pond scum", "disgusting smell")

_FOLD = str.maketrans({p[0]: p[1] for p in f"{LOOK_ALIKE} {SIGNS}".split()})
_WORD = re.compile(r"[^\W_]+").match
_PAIR = re.compile(r"[^\W_]+ [^\W_]+").match
_WORDS = re.compile(r"[^\W_]+").findall


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    """entries: {word beginning: weight}; phrases: where entries do not count."""

    entries: dict[str, float]
    phrases: tuple[str, ...] = PHRASES
    slope: float = 1.0
    shift: float = 0.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None)

    def _built(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for p in self.phrases:
                found.add_word(fold(p), (len(fold(p)), None))
            for e, w in self.entries.items():
                found.add_word(e, (len(e), w))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, str, float]]:
        """(place, entry, weight) of what counts in a folded text."""
        if not self.entries:
            return []
        found, shields = [], []
        for end, (n, weight) in self._built().iter(text):
            at = end - n + 1
            if at and text[at - 1].isalnum():
                continue
            if weight is None:
                shields.append((at, end))
            else:
                found.append((at, text[at : end + 1], weight))
        if shields:
            found = [m for m in found if not any(a <= m[0] <= b for a, b in shields)]
        return found

    def strength(self, text: str) -> float:
        """Sum of the weights of a text's matched words over the logarithm of its number of words."""
        folded = fold(text)
        found = self.matches(folded)
        # a word counts once however often a text repeats it
        total = sum({_WORD(folded, at)[0]: w for at, _, w in found}.values()) if found else 0.0
        return total / math.log(math.e + len(folded.split())) if total else 0.0

    def score_text(self, text: str) -> float:
        return float(1 / (1 + math.exp(-min(500.0, max(-500.0, self.slope * self.strength(text) + self.shift)))))


def _counted(sample: DataFrame) -> DataFrame:
    """(word, toxic, other): in how many documents of each kind, by partial counts of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string())] + [pa.array([counts[y][w] for w in words], pa.int64()) for y in (1, 0)],
                names=["word", "toxic", "other"],
            )
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                counts[y].update({w for w in _WORDS(fold(t.as_py())) if SHORTEST <= len(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
        yield out()

    parts = sample.select("text", "y").mapInArrow(run, "word string, toxic long, other long")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries of beginnings' counts: strong and frequent, as long as no support is lost, none inside another."""
    weight = {
        e: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
        for e, (a, b) in counts.items()
        if a >= max(LEAST_DOCUMENTS, SUPPORT * toxic)
    }
    strong = {e: w for e, w in weight.items() if w >= LEAST_WEIGHT}
    chosen: dict[str, float] = {}
    for e in sorted(strong, key=lambda x: (len(x), x)):
        if any(e[:n] in chosen for n in range(SHORTEST, len(e))):
            continue
        longer = e
        while True:  # the same words, said more exactly
            more = [x for x in sorted(strong) if len(x) == len(longer) + 1 and x.startswith(longer)]
            same = [x for x in more if counts[x][0] >= 0.9 * counts[e][0]]
            if not same:
                break
            longer = same[0]
        chosen[longer] = strong[longer]
    return {e: w for e, w in chosen.items() if not any(e[:n] in chosen for n in range(SHORTEST, len(e)))}


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple[str, ...] = PHRASES,
) -> Lexicon:
    """The lexicon and its curve, learned from labelled rows outside fold 0."""
    bounded_batches(docs.sparkSession)
    sample, share = training_rows(docs, labels, label, 5, MOST_ROWS, id_col, text_col)
    sample = sample.groupBy(F.sha2("text", 256).alias("h"), "y").agg(F.min(F.struct("id", "text")).alias("f")).select("f.id", "f.text", "y")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    odds = math.log(min(max(share, 1e-6), 1 - 1e-6) / min(max(1 - share, 1e-6), 1 - 1e-6))
    if len(n) < 2:
        return Lexicon({}, phrases, 0.0, odds)
    beginnings = F.transform(
        F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.col("word").substr(F.lit(1), k)
    )
    found = (
        _counted(sample)
        .select(F.explode(beginnings).alias("entry"), "toxic", "other")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") >= max(LEAST_DOCUMENTS, SUPPORT * n[1]))
        .where(F.col("toxic") / n[1] > 5 * F.col("other") / n[0])
        .collect()  # of a bounded sample, at most 1 / SUPPORT entries of each length in a word
    )
    # log-odds that a document with the entry is toxic, at the share among all training labels
    entries = {
        e: w + odds
        for e, w in choose({r["entry"]: (r["toxic"], r["other"]) for r in found}, n[1], n[0]).items()
        if w + odds > 0
    }
    bare = Lexicon(entries, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            strength, around = [], []
            for t in batch.column("text"):
                text = t.as_py()
                strength.append(bare.strength(text))
                folded, near = fold(text), set()
                for at, entry, _ in bare.matches(folded):
                    word = _PAIR(folded, at)
                    if word:
                        near.add(word[0])
                around.append(sorted(near))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(strength, pa.float64()), pa.array(around, pa.list_(pa.string()))], names=["y", "x", "near"]
            )

    rows = sample.mapInArrow(run, "y int, x double, near array<string>").collect()  # at most 2 * MOST_ROWS
    bad = {p for r in rows if r["y"] for p in r["near"]}
    fine = Counter(p for r in rows if not r["y"] for p in r["near"])
    phrases = phrases + tuple(sorted(p for p, k in fine.items() if k >= 3 and p not in bad))
    rows.sort(key=lambda r: (r["y"], r["x"]))
    y, x = np.array([r["y"] for r in rows], float), np.array([r["x"] for r in rows])
    # both classes count alike: toxic documents are few, and missing one costs more
    slope, shift = quality._curve(x, y)
    return Lexicon(entries, phrases, slope, shift - math.log(n[1] / n[0]))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    return quality.score(docs, lexicon, TOXIC_FROM, id_col, text_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted to be toxic, columns unchanged."""
    return quality.keep(docs, train(docs, labels, "toxic", id_col, text_col), text_col, lambda s: s < TOXIC_FROM)
