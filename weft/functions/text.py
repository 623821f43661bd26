"""Text folding, tokens and name keys: Python kernels, and native columns where Spark can say it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typography, word forms, legal forms, markers, sound rules.
TYPOGRAPHY = {
    "œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss", "’": "'", "‘": "'", "`": "'", "´": "'", "ʼ": "'",
    "–": "-", "—": "-", "‐": "-", "‑": "-", "＆": "&", "№": "no",
}
WORD_FORMS = {
    "street": "st", "road": "rd", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "drive": "dr",
    "lane": "ln", "court": "ct", "circle": "cir", "highway": "hwy", "place": "pl", "trail": "trl", "parkway": "pkwy",
    "square": "sq", "terrace": "ter", "expressway": "expy", "freeway": "fwy", "crossing": "xing", "mount": "mt",
    "marg": "marg", "saint": "st", "sainte": "ste", "rue": "r", "chemin": "ch", "impasse": "imp", "route": "rte",
    "faubourg": "fbg", "allee": "all", "allees": "all", "arrondissement": "arr", "north": "n", "south": "s",
    "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "suite": "ste", "apartment": "apt", "building": "bldg", "floor": "fl", "number": "no", "num": "no", "house": "h",
    "door": "h", "plot": "plot", "office": "off", "sector": "sec", "block": "blk", "limited": "ltd", "private": "pvt",
    "corporation": "corp", "incorporated": "inc", "company": "co", "l.l.c": "llc", "and": "&",
    "enterprises": "enterprise", "traders": "trader", "industries": "industry", "services": "service",
    "associates": "associate", "solutions": "solution", "technologies": "technology", "systems": "system",
    "products": "product", "holdings": "holding", "partners": "partner", "ventures": "venture",
    "brothers": "brother", "builders": "builder", "consultants": "consultant", "exports": "export",
    "laboratories": "laboratory", "labs": "lab", "communications": "communication", "first": "1", "second": "2",
    "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
}
LEGAL_FORMS = frozenset(
    "llc inc corp co ltd pvt llp lp pc pllc plc lllp pa psc sa sas sasu sarl eurl sci snc scop scp ei eirl selarl gmbh ag".split()
)
STOP_WORDS = frozenset("the of de la le du des & a an".split())
HONORIFICS = frozenset(["ms", "messrs", "mr", "mrs", "dr", "m s"])
DOMAIN_ENDS = frozenset("com net org www biz info".split())
ROUTING_NOISE = frozenset(["cedex"])
HOUSE_SUFFIXES = frozenset(["bis", "ter", "quater"])
SOUNDS = (
    ("ksh", "x"), ("ph", "f"), ("w", "v"), ("aa", "a"), ("ee", "i"), ("oo", "u"), ("th", "t"), ("bh", "b"),
    ("dh", "d"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("y", "i"), ("z", "j"), ("q", "k"),
)
#: Letters of the Indic blocks by their place in the block, which nine scripts share.
INDIC = {
    0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0F: "e", 0x10: "ai",
    0x13: "o", 0x14: "au", 0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "c", 0x1B: "ch", 0x1C: "j",
    0x1D: "jh", 0x1E: "ny", 0x1F: "tt", 0x20: "tth", 0x21: "dd", 0x22: "ddh", 0x23: "nn", 0x24: "t", 0x25: "th",
    0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r",
    0x32: "l", 0x33: "ll", 0x35: "v", 0x36: "sh", 0x37: "ss", 0x38: "s", 0x39: "h", 0x3E: "aa", 0x3F: "i", 0x40: "ii",
    0x41: "u", 0x42: "uu", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au",
}
_INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)

_TYPOGRAPHY = str.maketrans(TYPOGRAPHY)
# Patterns and their replacements before a text is cut into tokens, and ordinals.
_BEFORE_TOKENS = (
    (re.compile(r"\b(?:l|d|qu|j|m|n|s|t|c)'(?=[a-z])"), ""),
    (re.compile("'"), ""),
    (re.compile(r"\b([a-z])\s?-\s?(\d+)\b"), r"\1\2"),
    (re.compile(r"\b[a-z]?\d+[a-z]?(?:\s?[/-]\s?[a-z]?\d+[a-z]?)+\b"), lambda m: "_".join(map(number, re.split(r"\s?[/-]\s?", m[0])))),
)
_TOKEN = re.compile(r"[a-z0-9&_]+")
_ORDINAL = re.compile(r"0*(\d+)(?:st|nd|rd|th|er|e|eme)")


def number(token: str) -> str:
    """Digits without leading zeros; other tokens as they are."""
    return (token.lstrip("0") or "0") if token.isdigit() else token


def _latin(char: str) -> str:
    if char.isascii():
        return char
    code = ord(char)
    if code in range(_INDIC_BLOCKS.start, _INDIC_BLOCKS.stop):
        digit = unicodedata.digit(char, None)
        return str(digit) if digit is not None else INDIC.get((code - _INDIC_BLOCKS.start) % 0x80, "")
    return "".join(c for c in unicodedata.normalize("NFKD", char) if c.isascii())


def fold(text: str | None) -> str:
    """Compatibility form, plain typography, Latin letters without marks, lower case."""
    text = unicodedata.normalize("NFKC", text or "").translate(_TYPOGRAPHY)
    return (text if text.isascii() else "".join(map(_latin, text))).lower()


def _plain(found: Iterable[str]) -> Iterator[str]:
    """Tokens without routing noise and house suffixes, numbers in plain form."""
    last = ""
    for t in found:
        if t in ROUTING_NOISE or (t in HOUSE_SUFFIXES and last.isdigit()):
            continue
        ordinal = _ORDINAL.fullmatch(t)
        last = number(t) if not ordinal else ordinal[1]
        yield last


def _glued(found: Iterable[str]) -> Iterator[str]:
    """Neighbouring single letters become one token."""
    letters = ""
    for t in found:
        if len(t) == 1 and t.isalpha():
            letters += t
            continue
        if letters:
            yield letters
            letters = ""
        yield t
    if letters:
        yield letters


def tokens(folded: str, forms: dict[str, str] | None = None) -> list[str]:
    """Canonical tokens of a folded text, mapped by ``WORD_FORMS`` and then by ``forms``."""
    for pattern, put in _BEFORE_TOKENS:
        folded = pattern.sub(put, folded)
    found = (WORD_FORMS.get(t, t) for t in _glued(_plain(_TOKEN.findall(folded))))
    return [t for t in ((forms or {}).get(t, t) for t in found) if t]


def _single(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1", text)


def skeleton(text: str) -> str:
    """First letter and the other consonants, doubled ones once."""
    return text[:1] + _single(re.sub("[aeiou]", "", text[1:]))


def sound_key(text: str) -> str:
    """Skeleton after spelling variants of one sound are made alike."""
    for spelled, sound in SOUNDS:
        text = text.replace(spelled, sound)
    return skeleton(_single(text))


def metaphone(text: str, length: int = 12) -> str:
    """Metaphone code of ASCII words, joined by spaces, cut to ``length``."""
    return " ".join(filter(None, map(_metaphone_word, re.findall("[a-z]+", text.lower()))))[:length]


def _metaphone_word(w: str) -> str:
    for start, put in (("kn", "n"), ("gn", "n"), ("pn", "n"), ("wr", "r"), ("ae", "e"), ("wh", "w"), ("x", "s")):
        if w.startswith(start):
            w = put + w[len(start) :]
            break
    out = ""
    for i, c in enumerate(w):
        before, after, two = w[i - 1 : i], w[i + 1 : i + 2], w[i + 1 : i + 3]
        if c == before and c != "c":
            continue
        if c in "aeiou":
            out += c.upper() if i == 0 else ""
        elif c == "b":
            out += "" if before == "m" and not after else "B"
        elif c == "c":
            if two == "ia" or after == "h":
                out += "K" if before == "s" and after == "h" else "X"
            elif after and after in "iey":
                out += "" if before == "s" else "S"
            else:
                out += "K"
        elif c == "d":
            out += "J" if after == "g" and w[i + 2 : i + 3] and w[i + 2] in "iey" else "T"
        elif c == "g":
            if after == "h" and not (i + 2 == len(w) or w[i + 2] in "aeiou"):
                continue
            if after == "n" and (i + 2 == len(w) or w[i + 2 :] == "ed"):
                continue
            if before == "d" and after and after in "iey":
                continue
            out += "J" if after and after in "iey" else "K"
        elif c == "h":
            out += "H" if after and after in "aeiou" and not (before and before in "csptg") else ""
        elif c == "k":
            out += "" if before == "c" else "K"
        elif c == "p":
            out += "F" if after == "h" else "P"
        elif c == "q":
            out += "K"
        elif c == "s":
            out += "X" if after == "h" or two in ("io", "ia") else "S"
        elif c == "t":
            if two in ("ia", "io"):
                out += "X"
            elif after == "h":
                out += "0"
            elif two != "ch":
                out += "T"
        elif c == "v":
            out += "F"
        elif c in "wy":
            out += c.upper() if after and after in "aeiou" else ""
        elif c == "x":
            out += "KS"
        elif c == "z":
            out += "S"
        else:
            out += c.upper()
    return out


# Native columns.


def ascii_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits; other characters separate."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def plain_numbers(words: Column) -> Column:
    """Words of digits only, without leading zeros, distinct and sorted."""
    numbers = F.filter(words, lambda t: t.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda t: F.regexp_replace(t, "^0+(?=.)", ""))))


def with_forms(words: Column, forms: dict[str, str] = WORD_FORMS) -> Column:
    """Words replaced by their canonical form; found by the first letter, then in a short map."""
    by_letter: dict[str, list[str]] = {}
    for word, form in forms.items():
        by_letter.setdefault(word[:1], []).extend([word, form])
    tables = {letter: F.create_map(*[F.lit(x) for x in pairs]) for letter, pairs in by_letter.items()}

    def form(t: Column) -> Column:
        found = t
        for letter, table in tables.items():
            found = F.when(F.substring(t, 1, 1) == letter, F.coalesce(F.element_at(table, t), t)).otherwise(found)
        return found

    return F.transform(words, form)


#: The word forms and empty values of the first generation.
FIRST_FORMS = {
    "street": "st", "road": "rd", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "drive": "dr",
    "lane": "ln", "court": "ct", "circle": "cir", "highway": "hwy", "place": "pl", "trail": "trl", "parkway": "pkwy",
    "square": "sq", "terrace": "ter", "suite": "ste", "apartment": "apt", "building": "bldg", "floor": "fl",
    "north": "n", "south": "s", "east": "e", "west": "w", "saint": "st", "number": "no", "house": "h",
    "limited": "ltd", "private": "pvt", "corporation": "corp", "incorporated": "inc", "company": "co", "and": "&",
    "et": "&", "enterprises": "enterprise", "traders": "trader", "industries": "industry", "services": "service",
    "associates": "associate",
}
FIRST_EMPTY = ("none", "null", "nan", "n/a", "na", "<null>", "-")


def first_norm(text: Column) -> Column:
    """The first generation's form of a Latin text: lower case, words of letters, digits and &, canonical forms; null is empty."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("'"), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(low, "[^a-z0-9&]+", " "), " "), lambda t: t != "")
    return F.when(F.trim(low).isin(*FIRST_EMPTY), F.lit("")).otherwise(F.array_join(with_forms(words, FIRST_FORMS), " "))


def skeleton_col(text: Column) -> Column:
    rest = F.regexp_replace(F.substring(text, 2, 1_000_000_000), "[aeiou]", "")
    return F.concat(F.substring(text, 1, 1), F.regexp_replace(rest, r"(.)\1+", "$1"))


def sound_key_col(text: Column) -> Column:
    for spelled, sound in SOUNDS:
        text = F.replace(text, F.lit(spelled), F.lit(sound))
    return skeleton_col(F.regexp_replace(text, r"(.)\1+", "$1"))


def grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters; none if the text is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def gram_set(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; a shorter text is its own, an empty one has none."""
    short = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) >= n, F.array_distinct(grams(text, n))).otherwise(short)


def initials(words: Column) -> Column:
    """First letters of at least two words, else empty."""
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def url_name(url: Column) -> Column:
    """The label before a common domain ending, without hyphens; empty if there is none."""
    found = F.regexp_extract(F.lower(url), r"([a-z0-9][a-z0-9-]{2,})\.(com|net|org|in|co|biz|info|us|fr)([^a-z0-9_]|$)", 1)
    return F.replace(found, F.lit("-"), F.lit(""))
