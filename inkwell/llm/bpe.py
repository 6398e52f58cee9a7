"""Byte-pair encoding by a token automaton, and decoding.

The merges compile, in order, into a deterministic automaton over tokens. It begins with one state
for each base symbol, all of them joined. The gadget of the merge (u, v) -> uv takes the arc v out of
the state that u leads to, and gives every state that has the arc u an arc uv, which leads where v
led. What is left accepts, of all ways to cut a string into tokens, the one that the merges
make. So the state after a token depends on that token alone, and states need not be copied whole: a
state is the chain of gadgets that touched it. All arcs would be some thousand million (nearly every token may follow
nearly every other), so an arc is compiled when it is first walked: ``follows`` reads it by undoing gadgets from the
latest, and it stands in the table of arcs from then on. Labels compile into a table of transitions by symbol.

To encode a word, the tables are walked from left to right: from the state at each place the transitions by symbol
spell the labels that begin there, and an arc with that label leads to the state at the label's end. Each place is reached by one
path at most. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces, with_fields

#: Fixed values of the word-level scheme: the end-of-word mark and the contractions that are pieces of their own.
END = "</w>"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters and digits that Unicode 16.0, by which the scheme tells pieces apart, has beyond 15.1.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
DIGITS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Lower case of letters that Unicode 16.0 and 17.0, by which the scheme lower-cases, have beyond 15.1: (first, last, lower case of the first).
LOWER_17 = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER = {a + k: c + k for a, b, c in LOWER_17 for k in range(b - a + 1)}
#: Pieces of lower-cased text in Latin-1, which are found far more quickly.
LATIN_PIECES = re.compile(rf"{SHORT}|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\x09-\x0D \x85\xA0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: What a task keeps of words that it has seen (characters, with what they become), and of arcs.
_MOST_CHARS, _MOST_ARCS = 4_000_000, 400_000


@lru_cache
def piece_pattern() -> str:
    """The pattern of the pieces of any text, with letters and digits as in Unicode 16.0."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in found:
            ranges = found[kind]
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    text = lambda ranges: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    letter, digit = text([*found["L"], *LETTERS_16]), text([*found["N"], *DIGITS_16])
    space = r"\x09-\x0D \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
    return f"{SHORT}|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+"


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if plain else spare))
        spare += not plain
    return out


class Automaton:
    """Compiled from a tokenizer file of kind BPE with word ends; small enough to send to each task."""

    def __init__(self, definition: dict) -> None:
        model = definition["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in definition["added_tokens"]}
        #: What decoding emits for each arc.
        self.labels = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(vocab.values()) + 1
        self.when = array("i", [-1]) * size
        self.left, self.right = array("i", range(size)), array("i", range(size))
        self.gadget: dict[int, int] = {}
        self.pieces = piece_pattern()
        # labels of arcs: base symbols, and tokens that some string merges to
        tokens = {t: i for t, i in vocab.items() if len(t.removesuffix(END)) == 1}
        for turn, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._add(tokens, turn, vocab[a], vocab[b], vocab[a + b], a, b)
        #: Transitions by symbol: (node, symbol) to node; and the label complete at a node, in a word and at its end, or -1.
        self.steps: dict[int, int] = {}
        self.inner, self.final = array("i", [-1]), array("i", [-1])
        for t, i in tokens.items():
            node = 0
            for c in t.removesuffix(END):
                key = node << 16 | ord(c)
                if key not in self.steps:
                    self.steps[key] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.steps[key]
            (self.final if t.endswith(END) and len(t) > len(END) else self.inner)[node] = i

    def _add(self, tokens: dict[str, int], turn: int, u: int, v: int, uv: int, a: str, b: str) -> None:
        if self.when[uv] != -1:
            raise ValueError(f"two merges make the token {a + b!r}")
        if a not in tokens or b not in tokens or not self.follows(u, v):
            return  # earlier merges part the two wherever they would meet: the gadget finds no arc
        tokens[a + b] = uv
        self.when[uv], self.left[uv], self.right[uv] = turn, u, v
        self.gadget[u << 32 | v] = turn

    def follows(self, x: int, t: int) -> bool:
        """Whether the state after token ``x`` has the arc ``t``."""
        when, before = self.when, len(self.when)
        while True:
            if self.gadget.get(x << 32 | t, before) < before:
                return False
            if when[x] > when[t]:
                before, x = when[x], self.right[x]
            elif when[t] < 0:
                return True
            else:
                before, t = when[t] + 1, self.left[t]


class _Known(dict):
    """Words with what they become; starts anew when the words have ``_MOST_CHARS`` characters. A word longer than a
    thousandth of that isn't kept."""

    def __init__(self, make) -> None:
        self.make, self.chars = make, 0

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) * 1000 <= _MOST_CHARS:
            self.chars += len(word) + 8
            if self.chars > _MOST_CHARS:
                self.clear()
                self.chars = len(word) + 8
            self[word] = found
        return found


class Walker:
    """Encodes words by the automaton; holds the table of arcs and the words of late."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.labels = automaton, automaton.labels
        self.symbols = byte_symbols()
        self.arcs: dict[int, bool] = {}
        self.words = _Known(self._word)
        marks = [re.escape(s) for s in sorted(automaton.special, key=len, reverse=True)]
        self.cut = re.compile(f"({'|'.join(marks)})") if marks else None
        self.pieces = re.compile(automaton.pieces)

    def path(self, word: str) -> list[int]:
        """Tokens of one word, given as symbols."""
        automaton, arcs, n = self.automaton, self.arcs, len(word)
        steps, inner, final = automaton.steps, automaton.inner, automaton.final
        state, came = [-1] * (n + 1), [0] * (n + 1)
        codes = list(map(ord, word))
        for i in range(n):
            x, node = state[i], 0
            if i and x < 0:
                continue
            for j in range(i, n):
                node = steps.get(node << 16 | codes[j])
                if node is None:
                    break
                t = inner[node] if j < n - 1 else final[node]
                if t < 0:
                    continue
                if i:
                    key = x << 32 | t
                    known = arcs.get(key)
                    if known is None:
                        if len(arcs) >= _MOST_ARCS:
                            arcs.clear()
                        known = arcs[key] = automaton.follows(x, t)
                    if not known:
                        continue
                state[j + 1], came[j + 1] = t, i
        out, j = [], n
        while j:
            out.append(state[j])
            j = came[j]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        ids = array("I", self.path("".join(map(self.symbols.__getitem__, word.encode()))))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        ids = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                ids.append(self.automaton.special[part].to_bytes(4, "little"))
                continue
            if part.isascii():
                cut = LATIN_PIECES
                part = part.lower()
            else:
                part = unicodedata.normalize("NFC", part)
                if "Σ" in part:  # lower-casing goes by characters, without regard to word ends
                    part = part.replace("Σ", "σ")
                part = part.lower()
                try:
                    part.encode("latin-1")
                    cut = LATIN_PIECES
                except UnicodeEncodeError:
                    part, cut = part.translate(_LOWER), self.pieces
            ids += map(self.words.__getitem__, cut.findall(part))
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs ``ids``, joined by one space."""
        found = array("I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return " ".join(map(self.labels.__getitem__, found))


def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:
        return Automaton(json.load(file))


_walker: list = []


def _encode(automaton, batches: Iterator[pa.RecordBatch], passed: list[str]) -> Iterator[pa.RecordBatch]:
    if not _walker or _walker[0] != automaton.id:
        _walker[:] = [automaton.id, Walker(automaton.value)]
    walker = _walker[1]
    for b in pieces(batches, "text"):
        found = [walker.encode(t or "") for t in b.column("text").to_pylist()]
        columns = [b.column(c) for c in passed]
        columns += [pa.array([len(i) // 4 for i in found], pa.int64()), pa.array(found, pa.binary()), pa.array([walker.decode(i) for i in found], pa.string())]
        yield pa.record_batch(columns, names=[*passed, "n_tokens", "ids", "decoded"])


class _Sent:
    """The automaton by broadcast; it unpacks once in each worker."""

    def __init__(self, spark, automaton: Automaton, path: str) -> None:
        self.id, self._value = path, spark.sparkContext.broadcast(automaton)

    @property
    def value(self) -> Automaton:
        return self._value.value


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, the columns ``keep``, n_tokens, ids, decoded): a row for each row of ``docs``; ids as little-endian 32-bit integers.

    White space is dropped and text lower-cased, as the tokenizer file has it; the strings of its special
    tokens are those tokens. Null text is the empty text: no tokens. ``decoded`` comes from ``ids``. Repeated rows each get a row, other columns
    are ignored, and a text of any length is one row. ``tokenizer`` is the path of the file
    on the driver; the automaton (some MB, by the vocabulary) is broadcast. No rows move.
    """
    sent = _Sent(docs.sparkSession, load(tokenizer), tokenizer)
    rows = docs.select(F.struct(id_col, *(keep or [])).alias("row"), F.col(text_col).cast("string").alias("text"))
    shape = with_fields(rows.select("row"), "n_tokens long, ids binary, decoded string")
    return rows.mapInArrow(partial(_run, sent), shape).select("row.*", "n_tokens", "ids", "decoded")


def _run(sent: _Sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _encode(sent, batches, ["row"])
