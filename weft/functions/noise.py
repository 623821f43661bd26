"""Record texts for encoders, and seeded noise for training pairs."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import LEGAL_FORMS
from weft.operators.parse import NO_ADDRESS


def record_text(name: Column, address: Column, prefix: str = "query: ", between: str = " | ") -> Column:
    """Name and address as one text; addresses that say nothing are left out."""
    said = ~F.lower(F.trim(address)).isin(*sorted(NO_ADDRESS))
    return F.concat(F.lit(prefix), F.concat_ws(between, name, F.when(said, address)))


def pair_text(name: Column, address: Column, duplicates: Column | None = None) -> Column:
    """A record as one side of a pair for a cross encoder: "name ; address", and how many duplicates it has where that is given."""
    said = ~F.lower(F.trim(address)).isin(*sorted(NO_ADDRESS))
    more = F.concat(F.lit("dup "), duplicates.cast("string")) if duplicates is not None else F.lit(None).cast("string")
    return F.concat_ws(" ; ", name, F.when(said, address), more)


def _words(words: list[str], draw: random.Random) -> list[str]:
    if len(words) > 1 and draw.random() < 0.3:
        i = draw.randrange(len(words) - 1)
        words[i : i + 2] = words[i : i + 2][::-1]
    if len(words) > 1 and words[-1].lower().strip(".") in LEGAL_FORMS and draw.random() < 0.5:
        words = words[:-1]
    elif draw.random() < 0.1:
        words = [*words, draw.choice(sorted(LEGAL_FORMS))]
    return words


def _letters(word: str, draw: random.Random) -> str:
    if len(word) < 4 or draw.random() >= 0.15:
        return word
    i, kind = draw.randrange(1, len(word) - 1), draw.randrange(3)
    changed = {0: "", 1: word[i] * 2, 2: word[i + 1] + word[i]}[kind]
    return word[:i] + changed + word[i + (2 if kind == 2 else 1) :]


def noisy_name(name: str, seed: int) -> str:
    """Words swapped, a legal form dropped or added, letters dropped, doubled or swapped, case changed."""
    draw = random.Random(seed)
    words = [_letters(w, draw) for w in _words(name.split(), draw)]
    text = " ".join(words)
    case = draw.random()
    return text.upper() if case < 0.1 else text.lower() if case < 0.2 else text


def noisy_address(address: str, seed: int) -> str:
    """Segments dropped or shuffled, leading zeros dropped, rarely nothing left."""
    draw = random.Random(seed)
    if draw.random() < 0.05:
        return ""
    segments = [s.strip() for s in address.split(",")]
    if len(segments) > 2 and draw.random() < 0.3:
        del segments[draw.randrange(len(segments))]
    if draw.random() < 0.2:
        draw.shuffle(segments)
    return ", ".join(" ".join(w.lstrip("0") or "0" if w.isdigit() else w for w in s.split()) for s in segments)


def with_noise(kind, text: Column, key: Column, seed: int = 0) -> Column:
    """Noise drawn from the row's key, so the same row is changed alike at every run."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, seeds in parts:
            yield pd.Series([kind(t or "", int(s)) for t, s in zip(texts, seeds, strict=True)])

    return run(text, F.xxhash64(key, F.lit(seed)))
