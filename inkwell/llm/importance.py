"""Importance resampling towards a target distribution, by hashed n-gram features and a dictionary of distinct features.

Each task counts the n-gram strings of the texts that it reads, and the counts of equal strings are summed over the corpus: the dictionary. Strings move
in lists by part, in which those with one first word lie together, as they pack well so. Each of the dictionary's strings is hashed into its bucket once,
and the counts are summed by bucket, for the corpus and for the target texts. A bucket's gain is the log ratio of
its shares. The gains, one for each bucket, go back to the features of each document; a Gumbel key for each document, of its id, makes the highest
scores a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import pieces, stored, with_fields
from ._words import U, grams, inside, mix, utf8, words_of_bytes

BUCKETS, PERCENT, FEWEST, SEED = 10_000, 25, 20, 7
#: A word's followers are dealt into so many groups, so that a frequent word burdens no part; parts for each shuffle partition.
_GROUPS, _PARTS = 8, 4
#: Bytes of text whose features a task counts together.
_TOGETHER = 4 << 20
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Features:
    """Runs of one and two words of many texts: ``prints`` of all, and where each begins and ends in ``flat``, in which one space parts the words."""

    def __init__(self, column: pa.Array) -> None:
        data, at = utf8(column)
        data = _LOWER[data]
        w = words_of_bytes(data, at, _APART)
        self.n_words = np.diff(w.first)
        keep = ~_APART[data]
        ends = w.ends[w.ends < len(data)]
        keep[ends] = True  # the mark after a word, if it isn't the first byte of another
        place = np.cumsum(keep) - 1
        flat = data[keep]
        flat[place[ends[_APART[data[ends]]]]] = 32
        starts, stops = place[w.starts] if len(w.starts) else w.starts, place[w.ends - 1] + 1 if len(w.ends) else w.ends
        two = inside(w.first, 2)
        self.flat = flat.tobytes()
        self.prints = np.concatenate([w.prints, grams(w.prints, 2)[two]])
        self.starts, self.stops = np.concatenate([starts, starts[two]]), np.concatenate([stops, stops[two + 1]])
        text = w.owner()
        self.text = np.concatenate([text, text[two]])
        #: What deals features into parts.
        self.group = mix(np.concatenate([w.prints, w.prints[two] + w.prints[two + 1] % U(_GROUPS)]))

    def strings(self, which: np.ndarray, heads: np.ndarray) -> pa.Array:
        """Features, one in a line: a new string begins at each of ``heads``."""
        size = self.stops[which] - self.starts[which] + 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - (ends - size), size)
        data = np.frombuffer(self.flat, np.uint8)[np.minimum(at, len(self.flat) - 1)]
        data[ends - 1] = 10
        last = np.append(heads[1:], len(size)) - 1
        whole = np.ones(len(data), bool)
        whole[ends[last] - 1] = False
        offsets = np.append((ends - size)[heads] - np.arange(len(heads)), len(data) - len(heads))
        return pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[whole]))

    def buckets(self, which: np.ndarray) -> np.ndarray:
        flat, crc = self.flat, zlib.crc32
        return np.fromiter((crc(flat[a:b]) for a, b in zip(self.starts[which].tolist(), self.stops[which].tolist())), np.int64, len(which)) % BUCKETS


def _counted(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, features, n): different features, one in a line, and how often each occurs."""
    for b in pieces(batches, "text", _TOGETHER):
        f = Features(b.column("text"))
        if not len(f.prints):
            continue
        order = np.argsort(f.prints)
        new = np.flatnonzero(np.diff(f.prints[order], prepend=~f.prints[order[:1]]) != 0)
        which, n = order[new], np.diff(np.append(new, len(order)))
        group = f.group[which]
        near = np.lexsort((group, group % U(parts)))
        which, n, part = which[near], n[near].astype(np.int32), (group[near] % U(parts)).astype(np.int32)
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        counts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(which)).astype(np.int32)), pa.array(n))
        yield pa.record_batch([pa.array(part[heads]), f.strings(which, heads), counts], names=["part", "features", "n"])


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(feature, n, bucket): each distinct n-gram string of ``texts``, how often it occurs, and its bucket."""
    parts = _PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_counted, parts), "part int, features string, n array<int>")
    each = rows.repartition("part").select("part", F.inline(F.arrays_zip(F.split("features", "\n").alias("feature"), F.col("n").alias("n"))).alias("feature", "n"))
    counts = each.groupBy("part", "feature").agg(F.sum("n").alias("n"))  # where the rows are already
    return counts.select("feature", "n", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))


def bucket_counts(words: DataFrame) -> np.ndarray:
    """Occurrences by bucket; ``BUCKETS`` rows at most come to the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in words.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln) of its share of the target over its share of the source, both with one more in each bucket."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(gain: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", _TOGETHER):
        f = Features(b.column("text"))
        _, place, which = np.unique(f.prints, return_index=True, return_inverse=True)
        per = gain[f.buckets(place)][which] if len(place) else np.zeros(0, np.int64)
        n = np.bincount(f.text, minlength=b.num_rows)
        total = np.zeros(b.num_rows, np.int64)
        np.add.at(total, f.text, per)
        yield pa.record_batch([b.column("row"), pa.array(f.n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["row", "n_words", "n_features", "weight"])


def score(weight: Column, id_: Column) -> Column:
    """The weight and a Gumbel key, in thousandths, of ``SEED`` and the id (a null id as the empty string)."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, n_features, weight, score, rank): a row for each row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Words are runs of ASCII letters and digits and all non-ASCII characters, in which A-Z count as a-z; features are runs of one and two words. Null and
    empty texts have none, and weigh 0. ``rank`` numbers the drawn from 1: of the N documents with ``FEWEST`` words, floor(PERCENT N / 100) with
    the highest scores, ties to the smaller id, a null id last; rows that repeat an id tie by n_features. The others have no rank. An empty target, or an
    empty corpus, has a count of 0 everywhere. Columns beside these don't matter.
    """
    gain = gains(bucket_counts(dictionary(docs)), bucket_counts(dictionary(target)))
    rows = docs.select(F.struct(F.struct(*keep).alias("keep"), F.col("doc_id").cast("long").alias("id")).alias("row"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(partial(_weighed, gain), with_fields(rows.select("row"), "n_words long, n_features long, weight long"))
    scored = stored(weighed.select("row.keep", "row.id", "n_words", "n_features", "weight", score(F.col("weight"), F.col("row.id")).alias("score")))
    return ranked(scored).select("keep.*", "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame) -> DataFrame:
    """``rank`` by counts of scores: these are whole thousandths of logarithms, some ten thousand values whatever the corpus, so the driver
    adds up how many are higher, and only rows of one score are sorted together."""
    fit = F.col("n_words") >= FEWEST
    counts = {r["score"]: r["n"] for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()}
    drawn, higher, above = PERCENT * sum(counts.values()) // 100, 0, []
    for s in sorted(counts, reverse=True):
        if higher >= drawn:
            break
        above.append((s, higher))
        higher += counts[s]
    levels = F.broadcast(scored.sparkSession.createDataFrame(above, "score long, higher long"))
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features")
    picked = scored.where(fit).join(levels, "score").withColumn("rank", F.col("higher") + F.row_number().over(order))
    picked = picked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("higher")
    rest = scored.join(levels.select("score", F.lit(True).alias("high")), "score", "left").where(~fit | F.col("high").isNull()).drop("high")
    return picked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
