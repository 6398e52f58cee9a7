"""Mixing sources to target weights, by blocks of fixed length.

The words of a source's documents, one document after the other, are a stream that is cut into blocks. The mix is a number of output
shards with a fixed number of slots, each slot for one block. A shard draws how many of its slots go to each source; the slots of a source are
numbered over all shards, and a pseudorandom permutation of the source's block numbers, a new one for each pass over the source, says which block a slot
gets. Blocks and slots then meet by a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored
from ._words import U, mix as mixed_bits

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, slots in an output shard, passes over a source at most.
LENGTH, SLOTS, PASSES = 64, 4096, 3
#: Documents that are laid out in one sorted group, about.
_GROUP = 20_000
_ROUNDS = 4


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = PASSES) -> list[float]:
    """What each source should give of ``sum(sizes)``: shares by weight (``weights`` in turn), at most ``most`` times its size; what is over
    goes to the others by weight, until none is above."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = sum(sizes) - sum(most * sizes[k] for k in full)
        share = sum(w[k] for k in range(len(sizes)) if k not in full)
        over = {k for k in range(len(sizes)) if k not in full and rest * w[k] > most * sizes[k] * share}
        if not over:
            return [float(most * sizes[k]) if k in full else rest * w[k] / share for k in range(len(sizes))]
        full |= over


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of ``0..size - 1`` named by ``key`` takes ``index``: a Feistel network over the next
    even power of two, walked until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(U)
    out, todo = index.astype(U), np.arange(len(index))
    while len(todo):
        h = half[todo]
        low = (U(1) << h) - U(1)
        left, right = out[todo] >> h, out[todo] & low
        for k in range(_ROUNDS):
            left, right = right, left ^ (mixed_bits(right ^ mixed_bits(key[todo] + U(k))) & low)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(U)]
    return out.astype(np.int64)


def shard_counts(wanted: np.ndarray, shard: int, slots: int, seed: int) -> np.ndarray:
    """Slots of each source in a shard of ``slots``, of sources that want ``wanted`` in all: the whole part of what is expected, and a
    multinomial draw of the rest."""
    expected = wanted * (slots / wanted.sum())
    whole = np.floor(expected)
    rest = expected - whole
    left = slots - int(whole.sum())
    if left and rest.sum():
        whole += np.random.default_rng([seed, shard]).multinomial(left, rest / rest.sum())
    return whole.astype(np.int64)


def _draw(wanted: np.ndarray, total: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard: the slots of each source, which lie in it in a random order."""
    for b in batches:
        for shard in b.column("shard").to_pylist():
            n = min(SLOTS, total - shard * SLOTS)
            counts = shard_counts(wanted, shard, n, seed)
            slots = np.random.default_rng([seed, shard, 1]).permutation(int(counts.sum())).astype(np.int32)
            some = np.flatnonzero(counts)
            lists = np.split(slots, np.cumsum(counts[some])[:-1])
            yield pa.record_batch([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(lists, pa.list_(pa.int32()))], names=["shard", "s", "n", "slots"])


def _blocks(sizes: np.ndarray, most: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block of each slot; slots after ``most`` passes over their source stay empty."""
    for b in batches:
        slots = b.column("slots")
        times = np.diff(slots.offsets.to_numpy())
        s, shard, first = (np.repeat(b.column(c).to_numpy(), times) for c in ("s", "shard", "first"))
        turn = first + np.arange(len(s)) - np.repeat(np.cumsum(times) - times, times)
        slot = slots.flatten().to_numpy()
        size = sizes[s]
        fits = turn < most * size
        s, shard, turn, slot, size = s[fits], shard[fits], turn[fits], slot[fits], size[fits]
        key = mixed_bits(mixed_bits(s.astype(U) + U(seed)) + (turn // size).astype(U))
        yield pa.record_batch([pa.array(x) for x in (shard, slot, s, permuted(turn % size, size, key))], names=["shard", "slot", "s", "block"])


class Mix:
    """A mix of ``docs``.

    ``laid`` (row, s, source_size, target, size, start): each document with the place of its first word in its source's stream. ``spans`` (shard, slot, s, block,
    start, first_word, n_words): what fills each slot, in words of the document that starts at ``start`` of source number ``s``.
    """

    laid: DataFrame
    spans: DataFrame


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[int] = (1, 2, 3), length: int = LENGTH, most: int = PASSES, seed: int = 11) -> Mix:
    """Mix ``docs`` (doc_id, text, source) to ``targets`` of as many words as they have.

    Sizes are numbers of words (``WORD``; null text has none). Sources count in the order of their code points, the null source last; a source
    is a value of a small set, and one number for each comes to the driver. The order in a stream is by a hash of (id, text), then both, so a rerun
    gives the same mix; rows alike in both are alike in what is said of them. No block is taken more than ``most`` times, so no
    document either. Empty documents have a row in ``laid`` and no spans; of an empty table both are empty.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("print"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = stored(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = np.array([r["size"] for r in found], np.int64)
    goal = targets(sizes.tolist(), weights, most) if found else []
    blocks = -(-sizes // length)
    wanted = np.array([g * b / n if n else 0.0 for g, b, n in zip(goal, blocks.tolist(), sizes.tolist())])  # the last block of a source may be shorter

    names = spark.createDataFrame([(r["source"], k, r["size"], goal[k]) for k, r in enumerate(found)], "name string, s int, source_size long, target double")
    rows = rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    groups = max(64, -(-sum(r["n"] for r in found) // _GROUP))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "print"), F.lit(groups)))
    bases = rows.groupBy("s", "g").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("s", "g", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("base"))
    before = Window.partitionBy("s", "g").orderBy("id", "print", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
    out = Mix()
    out.laid = stored(within.join(bases, ["s", "g"]).select("row", "s", "source_size", "target", "size", (F.col("base") + F.col("within")).alias("start")))

    total = int(round(wanted.sum()))
    shards = spark.range(-(-total // SLOTS)).withColumnRenamed("id", "shard")
    drawn = shards.mapInArrow(partial(_draw, wanted, total, seed), "shard long, s int, n long, slots array<int>")
    order = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))  # a row for each shard and source
    filled = numbered.mapInArrow(partial(_blocks, blocks, most, seed), "shard long, slot int, s int, block long")

    last = F.col("start") + F.col("size")
    pieces = out.laid.where("size > 0").select("s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((last - 1) / length))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * length)
    end = F.least(last, (F.col("block") + 1) * length)
    pieces = pieces.select("s", "block", "start", (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words"))
    # a shard's row becomes thousands of slots, which the planner can't foresee: it must not broadcast them
    out.spans = filled.hint("merge").join(pieces, ["s", "block"]).select("shard", "slot", "s", "block", "start", "first_word", "n_words")
    return out


def taken(m: Mix) -> DataFrame:
    """(row, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    sums = m.spans.groupBy("s", "start").agg(F.sum("n_words").alias("taken"))
    # a document without words has the start of the one after it
    out = m.laid.withColumn("own", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.abs(F.xxhash64("row")) % 1000))
    out = out.join(sums.withColumnRenamed("start", "own").hint("merge"), ["s", "own"], "left")
    return out.select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def texts(m: Mix, docs: DataFrame) -> DataFrame:
    """(shard, slot, text): the words of each slot, joined by one space. ``docs`` (doc_id, text) must be those of the mix, and ids unique there."""
    words = docs.select(F.col("doc_id").alias("id"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    spans = m.spans.join(m.laid.where("size > 0").select("s", "start", F.col("row.doc_id").alias("id")), ["s", "start"])
    parts = spans.join(words, "id").select("shard", "slot", "start", F.array_join(F.slice("words", F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("part"))
    joined = parts.groupBy("shard", "slot").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    return joined.select("shard", "slot", F.array_join(F.col("parts.part"), " ").alias("text"))
