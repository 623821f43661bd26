"""String and set similarities: native columns, and kernels for Arrow UDFs where Spark has none."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import gram_set

UNKNOWN = -1.0


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; unknown if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(UNKNOWN)).otherwise(both / F.size(F.array_union(a, b)))


def gram_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Set cosine of character n-grams; 0 if a text is empty."""
    x, y = gram_set(a, n), gram_set(b, n)
    size = F.sqrt((F.size(x) * F.size(y)).cast("double"))
    return F.when(size > 0, F.size(F.array_intersect(x, y)) / size).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; equal empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def agreement(a: Column, b: Column) -> Column:
    """1 if equal, 0 if not, unknown if one is empty."""
    return F.when((a == "") | (b == ""), F.lit(UNKNOWN)).otherwise((a == b).cast("double"))


def weighted_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(weight shared / weight of the union, largest shared weight) of two map<token, weight>."""
    weight = F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    shared = F.transform(
        F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda t: F.greatest(F.element_at(a, t), F.element_at(b, t))
    )
    add = lambda s, x: s + x
    total = F.aggregate(F.map_values(weight), F.lit(0.0), add)
    part = F.aggregate(shared, F.lit(0.0), add)
    return F.when(total > 0, part / total).otherwise(F.lit(0.0)), F.coalesce(F.array_max(shared), F.lit(0.0))


# Kernels.


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised above 0.7 by a common prefix of up to four letters."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))  # noqa: B905
    return s + prefix * 0.1 * (1 - s)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one big integer of column bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * twice the common subsequence over both lengths; 100 for two empty texts."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def subsequence_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return common_subsequence(a, b) / longest if longest else 1.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """Best ratio of the shared words, and of those with each side's own words; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, [shared, " ".join(sorted(s))])) for s in (x - y, y - x))
    found = [ratio(left, right)]
    if shared:
        found += [ratio(shared, left), ratio(shared, right)]
    return max(found)


def _window_ratio(short: str, long: str) -> float:
    n, letters, best = len(short), set(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        # a window that ends outside the shorter text's letters is beaten by a smaller one
        if (window[-1] in letters or window[0] in letters) and 200.0 * len(window) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, cut at its edges; both ways for equal lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_window_ratio(a, b), _window_ratio(b, a))
    return _window_ratio(*sorted((a, b), key=len))


def soft_jaccard(a: list[str], b: list[str], least: float = 0.9) -> float:
    """Jaccard where words count as equal from a Jaro-Winkler similarity on, each used once in order."""
    free = list(b)
    matched = 0
    for x in a:
        hit = next((i for i, y in enumerate(free) if x == y or jaro_winkler(x, y) >= least), None)
        if hit is not None:
            del free[hit]
            matched += 1
    total = len(a) + len(b) - matched
    return matched / total if a and b else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean best Jaro-Winkler similarity, of both directions."""
    if not a or not b:
        return 0.0
    one, two = (sum(max(jaro_winkler(x, y) for y in q) for x in p) / len(p) for p in (a, b) for q in ((b,) if p is a else (a,)))
    return (one + two) / 2


def is_abbreviation(short: str, long: str) -> bool:
    """Up to five letters that start alike and occur in order in the longer word."""
    if not short or len(short) >= len(long) or len(short) > 5 or short[0] != long[0]:
        return False
    return common_subsequence(short, long) == len(short)


def of_columns(kernel: Callable, a: Column, b: Column) -> Column:
    """A kernel over two columns as an Arrow UDF; nulls count as empty, equal pairs of a batch are worked out once."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        done: dict = {}

        def one(p, q):
            key = (p if isinstance(p, str) else tuple(p), q if isinstance(q, str) else tuple(q))
            if key not in done:
                done[key] = float(kernel(*key) if isinstance(p, str) else kernel(list(key[0]), list(key[1])))
            return done[key]

        return pd.Series([one("" if p is None else p, "" if q is None else q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def first_features(pairs: DataFrame, name_a: str, name_b: str, address_a: str, address_b: str) -> DataFrame:
    """The pairs with the string features of the first generation, of normalised names and addresses; percentages as 0 to 100."""
    a, b, x, y = (F.coalesce(F.col(c), F.lit("")) for c in (name_a, name_b, address_a, address_b))

    def words(text: Column) -> Column:
        return F.filter(F.split(text, " "), lambda t: t != "")

    def numbers(text: Column) -> Column:
        return F.filter(words(text), lambda t: t.rlike("^[0-9]"))

    shared, every = F.size(F.array_intersect(words(x), words(y))), F.size(F.array_union(words(x), words(y)))
    return pairs.withColumns(
        {
            "name_ratio": of_columns(ratio, a, b),
            "name_tset": of_columns(set_ratio, a, b),
            "name_tsort": of_columns(sorted_ratio, a, b),
            "name_partial": of_columns(partial_ratio, a, b),
            "name_jw": of_columns(jaro_winkler, a, b),
            "addr_tset": of_columns(set_ratio, x, y),
            "addr_ratio": of_columns(ratio, x, y),
            "addr_jacc": shared / F.greatest(F.lit(1), every),
            "num_jacc": jaccard(numbers(x), numbers(y)),
            "name_in_addr": of_columns(partial_ratio, a, y),
            "len_a": F.length(a),
            "len_b": F.length(b),
            "addr_empty_b": (y == "").cast("int"),
        }
    )
