"""Pairs of similar token sets within one large table, block against block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.lineage import cut

#: Tokens, the most frequent ones, that have numbers of their own; tokens and sets of a block; counts that a task holds at a time.
KNOWN, TOKENS, SETS, CELLS = 1 << 17, 1 << 21, 1 << 16, 1 << 19
#: Rows that are numbered at a time.
ROWS = 2048
#: The first number of a known token; below are hashes.
FIRST = 1 << 62


def _frequent(words: DataFrame) -> pa.Array:
    """The most frequent tokens of (_t: different tokens), the rarest first, ``KNOWN`` at most, after those that share their hash with another one."""
    # counted batch by batch: an explode would find the tokens anew for the filter that Spark puts before it
    counts = cut(words.select("_t").mapInArrow(_counts, "_w string, _n long").groupBy("_w").agg(F.sum("_n").alias("_n")))
    of = np.array(counts.groupBy("_n").agg(F.count("*").alias("_of")).sort(F.desc("_n")).collect(), np.int64).reshape(-1, 2)
    enough = of[np.cumsum(of[:, 1]) <= KNOWN, 0]
    row = F.struct("_n", "_w").alias("_r")
    twins = counts.groupBy(F.xxhash64("_w").bitwiseAND(F.lit(FIRST - 1)).alias("_x")).agg(F.collect_list(row).alias("_r")).where(F.size("_r") > 1).select(F.lit(-1).alias("_o"), F.inline("_r"))
    top = counts.where(F.col("_n") >= int(enough[-1] if len(enough) else FIRST)).select(F.lit(0).alias("_o"), "_n", "_w")
    return top.unionByName(twins).groupBy("_w").agg(F.min("_o").alias("_o"), F.min("_n").alias("_n")).toArrow().sort_by([(c, "ascending") for c in ("_o", "_n", "_w")]).column("_w").combine_chunks()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("_t").flatten().value_counts()
        yield pa.record_batch([found.field("values"), found.field("counts")], names=["_w", "_n"])


def _numbered(sent, key: str, first: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set its hashes and known tokens as ascending numbers, and a digest of them; null for a set without tokens."""
    for batch in (x.slice(at, ROWS) for x in batches for at in range(0, len(x), ROWS)):
        lists = batch.column("_t")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        known = pc.fill_null(pc.index_in(lists.flatten(), value_set=sent.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.where(known < 0, batch.column("_x").flatten().to_numpy(zero_copy_only=False), known + first)
        row = np.repeat(np.arange(len(sizes)), sizes)
        number = number[np.lexsort((number, row))]
        ends, own = np.concatenate([[0], np.cumsum(sizes)]), number >= first
        digests = [hashlib.sha256(number[a:b].tobytes()).digest() if b > a else None for a, b in zip(ends, ends[1:])]
        lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row[of], minlength=len(sizes)))]).astype(np.int32), pa.array(x)) for of, x in ((~own, number[~own]), (own, (number[own] - first).astype(np.int32)))]
        yield pa.record_batch([batch.column(key), pa.array(digests, pa.binary()), *lists], names=[key, "_h", "_rare", "_known"])


def _packed(first: int, most_tokens: int, most_sets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of a part of the table as one row, or more if they are many: sorted by size, their tokens as places in the sorted numbers of all."""
    held, tokens, sets, step = [], 0, 0, min(512, most_sets)
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            held.append(part)
            tokens, sets = tokens + sum(len(part.column(c).flatten()) for c in ("_rare", "_known")), sets + len(part)
            if tokens >= most_tokens or sets >= most_sets:
                yield _block(held, first)
                held, tokens, sets = [], 0, 0
    if held:
        yield _block(held, first)


def _block(held: list[pa.RecordBatch], first: int) -> pa.RecordBatch:
    of = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    sizes = [pc.list_value_length(of.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_rare", "_known")]
    order = np.argsort(sizes[0] + sizes[1], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    numbers = np.concatenate([of.column("_rare").flatten().to_numpy(), of.column("_known").flatten().to_numpy().astype(np.int64) + first])
    codes, ids = np.unique(numbers, return_inverse=True)
    ids = ids[np.lexsort((ids, np.concatenate([np.repeat(place, n) for n in sizes])))].astype(np.int32)
    keys = [pa.array([of.column(c).take(pa.array(order)).to_pylist()], pa.list_(of.schema.field(c).type)) for c in ("_from", "_to", "_h")]
    return pa.record_batch([*keys, *(pa.array([x.tobytes()], pa.binary()) for x in ((sizes[0] + sizes[1])[order], codes, ids))], names=["_from", "_to", "_h", "_sizes", "_codes", "_ids"])


class _Sets:
    """A block, for a similarity of ``q`` / 200 at least: ``need`` is what a set must share with any partner, ``prefix`` how many of its rarest tokens
    hold one of them at least."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, q: int) -> None:
        of = lambda c: batch.column(c + side)[row]
        raw = lambda c, kind: np.frombuffer(of(c).as_buffer(), kind)
        self.first, self.last, self.digests = of("_from").values, of("_to").values, of("_h").values
        self.n, self.codes, self.ids = raw("_sizes", np.int64), raw("_codes", np.int64), raw("_ids", np.int32)
        self.need = -(-q * self.n // 200)
        self.prefix = self.n - self.need + 1
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.ends = np.concatenate([[0], np.cumsum(self.prefix)])
        self.head = self.ids[_spans(self.starts[:-1], self.prefix)]
        self.edge = self.codes[self.ids[self.starts[:-1] + self.prefix - 1]]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _similar(x: _Sets, y: _Sets, q: int, same: bool, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared): sets of ``x`` and sets of ``y`` that are not larger and share enough.

    What two sets share of their prefixes is counted for many pairs at once, in a window of ``y`` by size. Beyond the prefix that ends first there are less than ``need`` of its set.
    Only pairs that might still share enough are compared as a whole."""
    to = np.searchsorted(y.codes, x.codes)
    to = np.where(y.codes[np.minimum(to, len(y.codes) - 1)] == x.codes, to, -1)
    head, row = to[x.head], np.repeat(np.arange(len(x.n)), x.prefix)
    head, row = head[head >= 0], row[head >= 0]
    ends = np.searchsorted(row, np.arange(len(x.n) + 1))
    # for each token of ``y`` the sets that have it in their prefix, by size; low and high: those of the window
    at = np.sort(y.head.astype(np.int64) * len(y.n) + np.repeat(np.arange(len(y.n)), y.prefix))
    sets = (at % len(y.n)).astype(np.int32)
    counts = np.bincount(y.head, minlength=len(y.codes))
    low = np.cumsum(counts) - counts
    high = low.copy()
    per = np.cumsum(counts[head])
    work = np.concatenate([[0], per])[ends]
    lo, hi = np.searchsorted(y.n, x.need), np.searchsorted(y.n, x.n, "right")
    mark = np.zeros(len(y.codes), bool)
    a = w0 = w1 = 0
    while a < len(x.n):
        b = a + 1
        while b < len(x.n) and (b + 1 - a) * (hi[b] - lo[a]) <= cells and work[b + 1] - work[a] <= 2 * cells:
            b += 1
        np.add.at(low, y.head[y.ends[w0] : y.ends[lo[a]]], 1)
        np.add.at(high, y.head[y.ends[w1] : y.ends[hi[b - 1]]], 1)
        w0, w1 = lo[a], hi[b - 1]
        wide = w1 - w0
        own = head[ends[a] : ends[b]]
        times = high[own] - low[own]
        found = sets[_spans(low[own], times)] + np.repeat((row[ends[a] : ends[b]] - a) * wide - w0, times)
        shared = np.bincount(found, minlength=(b - a) * wide)
        least = (q * x.n[a:b] // (200 + q) - x.need[a:b] + 1)[:, None] + (q * y.n[w0:w1] // (200 + q))[None, :]
        hit = np.flatnonzero(shared >= np.maximum(least, 1, out=least).ravel())
        i, j, have = a + hit // max(wide, 1), w0 + hit % max(wide, 1), shared[hit]
        enough = -(-q * (x.n[i] + y.n[j]) // (200 + q))
        rest = np.where(x.edge[i] < y.edge[j], x.need[i], y.need[j]) - 1
        keep = (have + rest >= enough) & (y.n[j] >= x.need[i]) & (y.n[j] <= x.n[i])
        if same:
            keep &= i != j
        i, j = i[keep], j[keep]
        whole = np.empty(len(i), np.int64)
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for c, d in zip(cuts, [*cuts[1:], len(i)]):
            own = to[x.ids[x.starts[i[c]] : x.starts[i[c] + 1]]]
            own = own[own >= 0]
            mark[own] = True
            n = y.n[j[c:d]]
            whole[c:d] = np.add.reduceat(mark[y.ids[_spans(y.starts[j[c:d]], n)]], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = False
        keep = 200 * whole >= q * (x.n[i] + y.n[j] - whole)
        yield i[keep], j[keep], whole[keep]
        a = b


def _met(least: int, cells: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            yield _meet(batch, row, least, cells)


def _meet(batch: pa.RecordBatch, row: int, least: int, cells: int) -> pa.RecordBatch:
    q, same = 2 * least - 1, batch.column("_b1")[row] == batch.column("_b2")[row]
    x, y = (_Sets(batch, row, side, q) for side in "12")
    keys, of = np.unique(np.concatenate([z.to_numpy(zero_copy_only=False) for z in (x.first, y.first, x.last, y.last)]), return_inverse=True)
    n, m = len(x.n), len(y.n)
    first, last = of[: n + m], of[n + m :]
    # of each set (those of y after those of x) and each score the smallest key of a partner
    best = np.full((n + m) * (101 - least), len(keys), np.int32)
    if same:  # copies: all but the first are as similar as can be
        best[np.arange(n) * (101 - least) + 100 - least] = first[:n]
    for i, j, shared in _similar(x, y, q, same, cells):
        union = x.n[i] + y.n[j] - shared
        score = (200 * shared + union) // (2 * union) - least
        for one, other in ((i, j + n), (j + n, i)):
            use = first[other] < last[one]
            np.minimum.at(best, one[use] * (101 - least) + score[use], first[other[use]])
    best = best.reshape(n + m, 101 - least)[:, ::-1]  # highest score first: what follows is of use only from a smaller key on
    before = np.minimum.accumulate(np.hstack([last[:, None], best]), axis=1)
    who, score = np.nonzero(best < before[:, :-1])
    digests = pa.concat_arrays([x.digests, y.digests]).take(pa.array(who))
    return pa.record_batch([digests, pa.array(keys[best[who, score]], x.first.type), pa.array(100 - score, pa.int64())], names=["_h", "_before", "_score"])


def best_before(words: DataFrame, key: str, least: int) -> tuple[DataFrame, DataFrame]:
    """For (key, _t: different tokens): (key, _h), the rows with what tells their set, and (_h, _best): for each set that reaches ``least`` hundredths
    with another one, or has copies, an array of (_before, _score): from which smallest key on which Jaccard similarity is reached.

    Sets are compared once for all of their copies. They lie in blocks of some ``TOKENS`` tokens, each a row, and a task reads two of these where they were written: pairs and
    candidates are counted in its memory, and blocks are not sent out by a shuffle, so what is written grows with the table and not with its pairs. The work is quadratic by nature; rare tokens
    come first, so few of the pairs are looked at.

    Frequent tokens are numbered, others go by a hash of 62 bits, but those of one hash are numbered too, so that different tokens always differ."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast(_frequent(words))
    kind = dict(words.dtypes)[key]
    hashed = words.withColumn("_x", F.transform("_t", lambda w: F.xxhash64(w).bitwiseAND(F.lit(FIRST - 1))))
    sets = cut(hashed.mapInArrow(partial(_numbered, sent, key, FIRST), f"`{key}` {kind}, _h binary, _rare array<long>, _known array<int>"))
    sent.destroy()
    size = sets.agg(F.sum(F.size("_rare") + F.size("_known")), F.count("_h")).first()
    tokens = F.any_value(F.struct("_rare", "_known"))
    kinds = sets.where(F.col("_h").isNotNull() & F.col(key).isNotNull()).groupBy("_h").agg(F.min(key).alias("_from"), F.max(key).alias("_to"), tokens.alias("_t")).select("_from", "_to", "_h", "_t.*")
    parts = max(1, -(-(size[0] or 0) // TOKENS), -(-size[1] // SETS))
    packed = kinds.coalesce(parts).mapInArrow(partial(_packed, FIRST, 2 * TOKENS, 2 * SETS), f"_from array<{kind}>, _to array<{kind}>, _h array<binary>, _sizes binary, _codes binary, _ids binary")
    blocks = cut(packed.withColumn("_b", F.monotonically_increasing_id()))
    one, two = (blocks.select([F.col(c).alias(c + side) for c in blocks.columns]) for side in "12")
    met = one.hint("shuffle_replicate_nl").crossJoin(two).mapInArrow(partial(_met, least, CELLS), f"_h binary, _before {kind}, _score long")
    smallest = met.groupBy("_h", "_score").agg(F.min("_before").alias("_before"))
    return sets.select(key, "_h"), smallest.groupBy("_h").agg(F.collect_list(F.struct("_before", "_score")).alias("_best"))
