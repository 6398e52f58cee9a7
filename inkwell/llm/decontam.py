"""Benchmark decontamination by spaced seeds.

Tokens are the words of the lower-cased text, cut at white space and ASCII punctuation. A seed is the
hash of the tokens that a mask selects from ``SPAN`` consecutive ones; a mask ignores the others, so a
substitution there doesn't matter. Seeds of the benchmark meet those of the documents; each
hit fixes an alignment of item and document, along which a window of ``OVERLAP`` tokens (the whole item,
if shorter) must agree in a share of ``AGREE`` at least. Tokens are compared by fingerprints of 64 bits.

The benchmark is the stated query set: it goes out in blocks of bounded size, one after the other, and each block meets all
documents in a pass of its own that moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces, stored, with_fields
from ._words import U, grams, inside, mix, words

#: The masks; 1 selects, 0 ignores. Wherever the substitutions of a window of ``OVERLAP`` tokens stand that agrees in a share of ``AGREE``, one of
#: the masks fits between them; for items with fewer tokens the last one is needed too.
MASKS, FOR_SHORT = ("110110011", "100111101", "101011110", "110101101", "111111000"), "1111"
SPAN = len(MASKS[0])
OVERLAP, AGREE = 20, 0.8
#: Characters of the benchmark in a block, about (by hash of its rows), and so some MB of seeds.
BLOCK_CHARS = 4_000_000
_BITS = 20


def _seeds(prints: np.ndarray, mask: str) -> np.ndarray:
    m = len(prints) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(int(mask, 2)), U)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * U(0x9E3779B97F4A7C15) + prints[k : k + m]
    return mix(out)


class Seeds:
    """A block of items (id, text): their tokens, and for each mask the sorted seeds with their places."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        w = words(pa.array([(t or "").lower() for _, t in items], pa.string()), marks=True)
        self.ids = [i for i, _ in items]
        self.tokens = [w.prints[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        at = inside(w.first, SPAN)
        item = np.searchsorted(w.first, at, "right") - 1
        self.tables = {m: self._table(_seeds(w.prints, m)[at], item, at - w.first[item]) for m in MASKS}
        count = np.diff(w.first)
        at = inside(w.first, len(FOR_SHORT))
        item = np.searchsorted(w.first, at, "right") - 1
        some = (count[item] >= SPAN) & (count[item] < OVERLAP)
        if some.any():
            at, item = at[some], item[some]
            self.tables[FOR_SHORT] = self._table(_seeds(w.prints, FOR_SHORT)[at], item, at - w.first[item])
        # items too short for a mask: all their tokens, exactly
        self.short = {}
        for n in range(1, SPAN):
            own = np.flatnonzero(count == n)
            if len(own):
                self.short[n] = self._table(np.array([grams(self.tokens[i], n, 5)[0] for i in own], U), own, np.zeros(len(own), np.int64))

    @staticmethod
    def _table(seed: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(seed, kind="stable")
        sieve = np.zeros(1 << _BITS, bool)
        sieve[seed >> U(64 - _BITS)] = True
        return seed[order], item[order], at[order], sieve


#: Hits of one seed in one text that are paired place by place; of more, the alignments are found by correlation.
_PAIRED, _SPAN = 4096, 1 << 20


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The different values of p - q over all pairs. Texts that repeat a few words have very many pairs, of few differences:
    correlating the two sets of places takes no more memory than the places, and no pair by itself."""
    if len(p) * len(q) <= _PAIRED:
        return np.unique(np.subtract.outer(p, q))
    found = []
    for a in range(int(p.min()), int(p.max()) + 1, _SPAN):
        for b in range(int(q.min()), int(q.max()) + 1, _SPAN):
            x, y = p[(p >= a) & (p < a + _SPAN)] - a, q[(q >= b) & (q < b + _SPAN)] - b
            if not len(x) or not len(y):
                continue
            n = int(x.max()) + int(y.max()) + 1
            size = 1 << (n - 1).bit_length()
            one, two = np.zeros(size), np.zeros(size)
            one[x], two[y.max() - y] = 1, 1
            both = np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size)[:n]
            found.append(np.flatnonzero(both > 0.5) - int(y.max()) + a - b)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _alignments(table: tuple[np.ndarray, ...], seed: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The different (text, item, shift) of equal seeds; ``at`` is the place of each seed in its text."""
    keys, items, places, sieve = table
    near = np.flatnonzero(sieve[seed >> U(64 - _BITS)])
    near = near[np.isin(seed[near], keys)]
    near = near[np.lexsort((at[near], seed[near], text[near]))]
    out = []
    if not len(near):
        return np.zeros((0, 3), np.int64)
    low, high = np.searchsorted(keys, seed[near], "left"), np.searchsorted(keys, seed[near], "right")
    new = np.ones(len(near), bool)
    new[1:] = (seed[near[1:]] != seed[near[:-1]]) | (text[near[1:]] != text[near[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(near)))
    many = count * (high - low)[first] > _PAIRED
    for i in np.flatnonzero(many):
        own = near[first[i] : first[i] + count[i]]
        hits = slice(low[first[i]], high[first[i]])
        for item in np.unique(items[hits]):
            shift = differences(at[own], places[hits][items[hits] == item])
            out.append(np.stack([np.full(len(shift), text[own[0]]), np.full(len(shift), item), shift], 1))
    few = ~np.repeat(many, count)
    near, low, high = near[few], low[few], high[few]
    for s in np.array_split(np.arange(len(near)), max(1, int((high - low).sum()) >> 20)):
        times = high[s] - low[s]
        place = np.repeat(low[s] - np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64), times) + np.arange(times.sum()) if len(s) else s
        where = np.repeat(near[s], times)
        out.append(np.unique(np.stack([text[where], items[place], at[where] - places[place]], 1), axis=0))
    return np.concatenate(out)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Best window along the alignment doc[shift + k] ~ item[k]: (start in doc, length, agreeing tokens);
    agreeing 0 where none reaches the share."""
    size = min(OVERLAP, len(item))
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < size:
        return 0, 0, 0
    same = np.concatenate([[0], np.cumsum(item[low:high] == doc[shift + low : shift + high])])
    agree = same[size:] - same[:-size]
    best = int(agree.argmax())
    if agree[best] < AGREE * size:
        return 0, 0, 0
    # all windows that reach the share, from the first to the last
    good = np.flatnonzero(agree >= AGREE * size)
    start, end = int(good[0]), int(good[-1]) + size
    return shift + low + start, end - start, int(same[end] - same[start])


def found_in(column: pa.Array, seeds: Seeds) -> list[dict[int, tuple[int, int, int]]]:
    """For each text, by item: the verified overlap with most agreeing tokens, the first of those."""
    w = words(column, marks=True)
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(column))]
    jobs = [(t, _seeds(w.prints, m), inside(w.first, len(m))) for m, t in seeds.tables.items()]
    jobs += [(t, grams(w.prints, n, 5), inside(w.first, n)) for n, t in seeds.short.items()]
    found = []
    for table, seed, at in jobs:
        text = np.searchsorted(w.first, at, "right") - 1
        found.append(_alignments(table, seed[at], text, at - w.first[text]))
    found = np.unique(np.concatenate(found), axis=0)
    if not len(found):
        return out
    for own in np.split(found, np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(axis=1)) + 1):
        text, item = own[0, :2].tolist()
        doc, tokens, shift = w.prints[w.first[text] : w.first[text + 1]], seeds.tokens[item], own[:, 2]
        # what an alignment can reach at most; the search ends when no other can do better
        most = np.minimum(len(tokens), len(doc) - shift) - np.maximum(0, -shift)
        best = (0, 0, 0)
        for k in np.argsort(-most, kind="stable"):
            if most[k] < best[2]:
                break
            spot = overlap(doc, tokens, int(shift[k]))
            if spot[2] > best[2] or spot[2] == best[2] and spot[2] and spot < best:
                best = spot
                if best[2] == len(tokens):
                    break
        if best[2]:
            out[text][item] = best
    return out


def _search(seeds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        found = [(i, seeds.value.ids[item], *spot) for i, own in enumerate(found_in(b.column("text"), seeds.value)) for item, spot in own.items()]
        rows = b.column("id").take(pa.array([f[0] for f in found], pa.int64()))
        yield pa.record_batch([rows, *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3, 4))], names=["id", "item_id", "start", "length", "agreeing"])


def _clean(seeds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        yield b.filter(pa.array([not own for own in found_in(b.column("text"), seeds.value)], pa.bool_())).drop_columns(["text"])


def _blocks(benchmark: DataFrame) -> Iterator[tuple]:
    """Broadcast seeds of the benchmark, one block after the other, each with whether it is the last. Null texts are left
    out; a null id is -1."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Seeds([tuple(r) for r in own.orderBy("item_id", "text").collect()])), k == n - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start, length, agreeing): a row for each row of ``docs`` and benchmark item (item_id,
    text) that it overlaps: the first word of the overlap in the document, its words, and how many agree.

    Null and empty texts on either side overlap nothing. Items of one to eight words must occur whole.
    Repeated rows of ``docs`` each get their rows; repeated items count once. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    shape = with_fields(rows.select("id"), "item_id long, start long, length long, agreeing long")
    found = []
    for seeds, last in _blocks(benchmark):
        part = rows.mapInArrow(partial(_search, seeds), shape)
        if not last:
            part = stored(part)
            seeds.destroy()
        found.append(part)
    if not found:
        return docs.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that overlap no item of the benchmark. Null and empty texts stay."""
    rows = docs.select(F.struct("*").alias("row"), F.lower(F.col(text_col).cast("string")).alias("text"))
    shape = rows.select("row").schema
    for seeds, last in _blocks(benchmark):
        kept = rows.mapInArrow(partial(_clean, seeds), shape)
        if not last:
            kept = stored(kept)
            seeds.destroy()
        rows = kept.withColumn("text", F.lower(F.col("row")[text_col].cast("string")))
    return rows.select("row.*")
