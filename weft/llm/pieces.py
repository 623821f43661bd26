"""SentencePiece BPE encoding and decoding, exact, by backtracking.

A sequence of pieces is the model's own encoding of a text if and only if
every piece encodes to itself and every two neighbours, put together,
encode to just those two. So a text is read from left to right, the longest
piece first (from an Aho-Corasick automaton over the vocabulary), each
neighbour pair is checked by re-merging its text, and a position from which
no piece fits is marked in a bitfield and never tried again: the encoding
of a prefix is unique, so one failure there is final.

The model file is parsed here (pieces, scores, types, normaliser flags), as
merges consider ordinary pieces only. Supported: BPE models with byte
fallback, identity normalisation, and no user-defined pieces; others raise
``ValueError``.

No piece holds the word mark after another character, so no merge crosses
the front of a run of marks. Texts are cut there, at line feeds where no
piece holds one, and before punctuation that no piece holds after a letter
or digit; the cuts' encodings are remembered, which changes no result.

Edge cases: null text counts as empty, which encodes to the end id alone
and decodes to the empty text; repeated rows and null ids pass through; an
empty table gives an empty result; only the id and text columns are read.
Long texts and long words need memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bounded_batches, remembered

MARK = "▁"
#: Cuts (about 350 bytes each) and neighbour pairs remembered by a worker before it starts anew.
CUTS_KEPT = 1_000_000
PAIRS_KEPT = 400_000
#: Longer cuts are not remembered.
CUT_LENGTH = 48

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError("not a SentencePiece model")


class _Remembered(dict):
    """A bounded memo: the missing key is computed, a full table starts anew."""

    def __init__(self, make, most: int, fits=lambda key: True):
        super().__init__()
        self.make, self.most, self.fits = make, most, fits

    def __missing__(self, key):
        value = self.make(key)
        if self.fits(key):
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, data: bytes):
        self.text: list[str] = []
        self.kind: list[int] = []
        rank: dict[str, float] = {}
        model, byte_fallback, prefix, collapse, charsmap = 1, False, True, True, b""
        suffix = False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                kind = own.get(3, _NORMAL)
                self.text.append(own[1].decode())
                self.kind.append(kind)
                if kind == _NORMAL:
                    rank[self.text[-1]] = -own.get(2, 0.0)
            elif number == 2:
                own = dict(_fields(value))
                model, byte_fallback, suffix = own.get(3, 1), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif number == 3:
                own = dict(_fields(value))
                charsmap, prefix, collapse = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if model != _BPE or not byte_fallback or charsmap or collapse or suffix or _USER in self.kind:
            raise ValueError("only identity-normalised BPE models with byte fallback are supported")
        self.rank, self.prefix = rank, prefix
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == _NORMAL}
        byte = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == _BYTE}
        self.byte = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self.value = {i: b for b, i in enumerate(self.byte)}
        self.end = self.text.index("</s>")
        self.longest_piece = max(map(len, self.id))
        whole = {t for t in self.id if len(t) == 1 or self.remerge(t) == [t]}
        self.automaton = ahocorasick.Automaton()
        for t in whole:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.whole = whole
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 1, -1) if t[:n] in whole), t[:1]) for t in whole if len(t) > 1}
        if any(MARK in t.lstrip(MARK) for t in whole):
            cut = ".+"  # merges may cross anything: one cut
        else:
            after = {t[i] for t in whole for i in range(1, len(t)) if t[i - 1].isalnum()}
            line = "" if any("\n" in t for t in whole if len(t) > 1) else "\n"
            ends = re.escape("".join(c for c in ",.;:!?|&%$#*" if c not in after)) + MARK + line
            cut = f"{MARK}*[^\\W_]+(?=[{ends}]|$)|{MARK}*[^{MARK}{line}]+|{MARK}+" + "|\n" * bool(line)
        self.cuts = re.compile(cut, re.DOTALL).findall
        self.fits = _Remembered(lambda pair: self.remerge(pair[0] + pair[1]) == [*pair], PAIRS_KEPT)
        self.done = _Remembered(self._cut, CUTS_KEPT, lambda key: len(key) <= CUT_LENGTH)

    def remerge(self, text: str) -> list[str]:
        """The merges themselves: the best-scored neighbour pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _longest(self, text: str, at: int) -> str:
        reach = self.automaton.longest_prefix(text[at : at + self.longest_piece])
        while reach > 1:
            piece = text[at : at + reach]
            if piece in self.whole:
                return piece
            reach -= 1
        return text[at]

    def split(self, text: str) -> list[str]:
        """The pieces of normalised text; a character without a piece stands for itself."""
        if text in self.whole:
            return [text]
        n, at, out = len(text), 0, []
        failed = bytearray((n >> 3) + 1)
        fits, shorter = self.fits, self.shorter
        piece: str | None = self._longest(text, 0)
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1], piece]):
                    break
                piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError("a text always has an encoding")
                last = out.pop()
                at -= len(last)
                piece = shorter.get(last)
                continue
            out.append(piece)
            at = end
            if at < n:
                piece = self._longest(text, at)
        return out

    def ids_of(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is None:
                ids.extend(self.byte[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return ids

    def _raw(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.kind[i] == _NORMAL:
                out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def _cut(self, cut: str) -> tuple[int, str, str]:
        ids = self.ids_of(self.split(cut))
        return len(ids), " ".join(map(str, ids)), self._raw(ids)

    def normalise(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix and text else text

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without the end id."""
        return [i for c in self.cuts(self.normalise(text)) for i in self.ids_of(self.split(c))]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids have none, the leading mark of the prefix goes."""
        text = self._raw(ids)
        return text[1:] if self.prefix and text[:1] == " " else text

    def both(self, text: str) -> tuple[int, str, str]:
        """(number of ids with the end id, the ids as text, the decoded text)."""
        done = self.done
        found = [done[c] for c in self.cuts(self.normalise(text))]
        ids = " ".join([f[1] for f in found] + [str(self.end)])
        back = "".join([f[2] for f in found])
        if self.prefix and back[:1] == " ":
            back = back[1:]
        return sum([f[0] for f in found]) + 1, ids, back


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


remembered(codec.cache_clear)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int> with the end id, decoded string) of every row; ``path`` is on every node."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t.as_py() or "") + [c.end] for t in batch.column(1)]
            back = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                names=[id_col, "ids", "decoded"],
            )

    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): ``encode`` without carrying the ids along."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            n, ids, back = [], [], []
            for t in batch.column(1):
                count, i, b = c.both(t.as_py() or "")
                n.append(count)
                ids.append(sha(i.encode()).hexdigest())
                back.append(sha(b.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    own = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
