"""Words of many texts at once as 64-bit fingerprints, by numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``. Its fingerprint is a
polynomial in a fixed odd base over random byte values, modulo 2**64, then mixed; the same
word has the same fingerprint on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: As above, and ASCII punctuation: words are then runs of ASCII letters, digits and non-ASCII characters.
_MARKS = _SPACE.copy()
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 64, 256, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """``prints[first[i]:first[i + 1]]`` are the words of text ``i``; starts and ends index ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    prints: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each starts; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, marks: bool = False) -> Words:
    """``marks``: ASCII punctuation separates words too."""
    return words_of_bytes(*utf8(column), _MARKS if marks else _SPACE)


def words_of_bytes(data: np.ndarray, at: np.ndarray, apart: np.ndarray = _SPACE) -> Words:
    blank = apart[data]
    begins = ~blank
    stops = ~blank
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        begins[1:] &= blank[:-1] | cut[1:-1]
        stops[:-1] &= blank[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, _prints(data, starts, ends), np.searchsorted(starts, at))


def _prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(ends, low + _CHUNK, "right"))
        if j <= i:  # one word longer than a chunk
            value = 0
            for k in range(low, int(ends[i]), _CHUNK):
                part = _BYTE[data[k : min(k + _CHUNK, int(ends[i]))]]
                value = (value * 0x2545F4914F6CDD1D + int((part * _UP[: len(part)]).sum(dtype=U))) % (1 << 64)
            out[i] = U(value)
            i += 1
            continue
        sums = np.zeros(int(ends[j - 1] - low) + 1, U)
        np.cumsum(_BYTE[data[low : ends[j - 1]]] * _UP[: len(sums) - 1], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
        i = j
    return mix(out + (ends - starts).astype(U))


def grams(prints: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Fingerprint of each ``n`` consecutive words of the concatenated texts (those over a border too)."""
    m = len(prints) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    base = U((_BASE * (2 * seed + 3)) % (1 << 64) | 1)
    out = prints[:m] ^ U(seed)
    for k in range(1, n):
        out = out * base + prints[k : k + m]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` words lie in one text, in order."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    skip = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else 0
    return np.arange(total) + skip


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
