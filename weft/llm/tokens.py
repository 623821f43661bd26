"""Token ids by the tokenizers library, with the ids of equal cuts remembered.

Both supported families split a text into pre-tokens before any merge, and
no pre-token crosses certain places: in models that drop white space any
white space at all, in byte-level models the front of a space that does not
follow other white space. Texts are cut there, every distinct cut is
encoded by the library, and the ids of a text are those of its cuts in
order. Texts with other runs of white space are cut by the byte-level
pattern's own white-space rules, more slowly; other tokenizers, and texts
with white space on which Arrow and the library differ, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from weft.llm.common import remembered  # noqa: E402

#: Cuts remembered by a worker before it starts anew, at about 220 bytes each;
#: with those of one batch more it stays below the size at which the table doubles.
CUTS_KEPT = 1_200_000
#: Bytes of texts whose cuts are looked up together.
GROUP_BYTES = 9_000_000

_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall


class Ids:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = CUTS_KEPT):
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "bytes"
        elif pre.get("type") == "Sequence" and norm is not None:
            names = [x["type"] for x in (norm.get("normalizers") or [norm])]
            first = pre["pretokenizers"][0]
            drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
            if drops and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and set(names) <= {"NFC", "Replace", "Lowercase"}:
                self.kind = "white"
        #: Of a byte-level model, the ids of a space and the cut.
        self.known: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, cuts: list[str]) -> list[bytes | None]:
        """The ids of distinct cuts, of a byte-level model with a space before each; None where none may end.

        Letters and digits are other pre-tokens than the full stops and
        commas after them, so those are encoded apart; a model that lowers
        letters has the same ids for a cut's lower case (asked of ASCII only).
        """
        known, lead, lower = self.known, " " if self.kind == "bytes" else "", self.kind == "white"
        if len(known) > self.kept:
            known.clear()
        found = list(map(known.get, cuts))
        later: list[tuple[int, str, str]] = []
        for i, x in enumerate(found):
            if x is None:
                c = cuts[i]
                key = c.rstrip(".,")
                # lowering some letters adds marks, which would join the stops
                if len(key) == len(c) or not (key.isalnum() and (key.isascii() or key.lower().isalnum())):
                    key = c
                stop = c[len(key) :]
                if lower and key.isascii():
                    key = key.lower()
                if stop and stop not in self.stops:
                    self.stops[stop] = self._encode([stop])[0]
                if (ids := known.get(key)) is None:
                    later.append((i, key, stop))
                else:
                    found[i] = ids + self.stops[stop] if stop else ids
        new = {key for _, key, _ in later}
        # a word of ASCII letters is one pre-token, its bytes stand for themselves: straight to the model
        word, mark = self.tokenizer.model.tokenize, "Ġ" if lead else ""
        letters = [k for k in new if k.isascii() and k.isalpha()]
        known.update([(k, array("I", [t.id for t in word(mark + k)]).tobytes()) for k in letters])
        for some in batched(new.difference(letters), 50_000):
            known.update(zip(some, self._encode([lead + k for k in some]), strict=True))
        for i, key, stop in later:
            found[i] = known[key] + self.stops[stop] if stop else known[key]
        if lead:
            for key in {key for _, key, _ in later if not key or key[-1].isspace()}:
                del known[key]
            for i, key, _ in later:
                if not key or key[-1].isspace():
                    found[i] = None
        return found

    def _runs(self, texts: list[str]) -> list[bytes]:
        """Texts of a byte-level model with runs of white space."""
        cuts = [_RUNS(t) for t in texts]
        parts = list(set().union(*cuts))
        ids = dict(zip(parts, self._encode(parts), strict=True))
        return [b"".join([ids[c] for c in own]) for own in cuts]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text (none is null)."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        n = len(texts)
        if not self.kind or not n:
            return self._encode(texts.to_pylist())
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ") if self.kind == "bytes" else pc.utf8_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        cuts = words.dictionary.to_pylist()
        ids = self._ids_of(cuts)
        if self.kind == "bytes":
            ended = np.array([x is None for x in ids], bool)
            slow = np.add.reduceat(ended[which], bounds[:-1]) > 0
            begin = bounds[:-1] + 1  # the first cut has no space before it
            firsts = self._encode([cuts[i] for i in which[bounds[:-1]]])
        else:
            slow, begin, firsts = np.zeros(n, bool), bounds[:-1], None
        flat = pa.array([x or b"" for x in ids], pa.large_binary()).take(words.indices)
        places = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
        data = memoryview(flat.buffers()[2] or b"")
        lows, highs = places[begin].tolist(), places[bounds[1:]].tolist()
        out = [bytes(data[a:b]) for a, b in zip(lows, highs, strict=True)]
        if firsts is not None:
            out = [a + b for a, b in zip(firsts, out, strict=True)]
        runs = np.flatnonzero(slow & ~odd)
        for i, x in zip(runs, self._runs(texts.take(pa.array(runs)).to_pylist()), strict=True):
            out[i] = x
        whole = np.flatnonzero(odd)
        for i, x in zip(whole, self._encode(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = x
        return out


def grouped(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until they hold ``size`` bytes: fewer distinct cuts a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def ids(path: str, kept: int = CUTS_KEPT) -> Ids:
    return Ids(path, kept)


remembered(ids.cache_clear)
