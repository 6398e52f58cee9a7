"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Each task counts the ``ORDER``-grams of characters, as they are, of the trusted texts that it reads; the counts are
summed by hash-sharded aggregation, and joins of the counts of neighbouring orders give discounts, context totals,
back-off weights and probabilities. The model has whatever n-grams the trusted texts have: it grows with them.

A text's log probability is a sum over its n-grams of all orders, each with one weight: what an n-gram adds to
the estimate without its first character, and, as a context, its back-off weight. So one join of texts' n-grams with the
sharded weights gives every perplexity. The ``HOT`` weights of highest count go out by broadcast, and a
bit sieve of fixed size tells which of the others a text may have; only those are joined.

Each text's perplexity is held against a quantile of held-out trusted texts in its language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces, stored, with_fields
from ._words import U, inside, mix

ORDER = 5
START, END = "\x02", "\x03"
#: Weights that are broadcast, at most (12 bytes each), and bits of the sieve of the others (8 MB).
HOT, SIEVE = 1 << 20, 26
#: Characters looked at together, and n-grams that a task holds before it passes their counts on.
_SLICE, _HELD = 1 << 18, 1 << 19
#: Rows whose sums a task keeps, as a power of two.
_LATE = 20
_STEP = U(0x9E3779B97F4A7C15)
_CONTEXT = U(0x5851F42D4C957F2D)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (rows, at, own): for each character of each text and its end, the row of ``rows`` with the ``ORDER``
    characters that it ends, and the index of the text. A text without characters has none."""
    held: list[str] = []
    own: list[int] = []

    def arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(h) for h in held])
        at = inside(np.concatenate([[0], np.cumsum(size)]), ORDER)
        return np.lib.stride_tricks.sliding_window_view(code, ORDER), at, np.repeat(own, size - ORDER + 1)

    n = 0
    for i, text in enumerate(texts):
        whole = START * (ORDER - 1) + text + END if text else ""
        for a in range(0, len(whole) - ORDER + 1, _SLICE):
            held.append(whole[a : a + _SLICE + ORDER - 1])
            own.append(i)
            n += len(held[-1])
            if n >= _SLICE:
                yield arrays()
                held, own, n = [], [], 0
    if held:
        yield arrays()


def _prints(rows: np.ndarray, at: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Fingerprints of (language, row)."""
    h = rows[:, 0].astype(U)
    for k in range(1, ORDER):
        h = h * _STEP + rows[:, k]
    return mix(h[at] + seed)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct fingerprints, a place of each, and which of them each is."""
    found = np.unique(h)
    which = np.searchsorted(found, h)
    place = np.empty(len(found), np.int64)
    place[which] = np.arange(len(h))
    return found, place, which


def _strings(codes: np.ndarray) -> list[str]:
    flat = np.ascontiguousarray(codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    seeds: list[int] = []
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def counted() -> pa.RecordBatch:
        _, codes, lang, n = held[0]
        known = list(names)
        return pa.record_batch([pa.array([known[x] for x in lang.tolist()], pa.string()), pa.array(_strings(codes), pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def merge() -> None:
        key, codes, lang, n = (np.concatenate(x) for x in zip(*held))
        found, place, which = np.unique(key, return_index=True, return_inverse=True)
        held[:] = [(found, codes[place], lang[place], np.bincount(which, n, len(found)).astype(np.int64))]

    for b in pieces(batches, "text"):
        for x in b.column("lang").to_pylist():
            if x not in names:
                names[x] = len(names)
                seeds.append(_seed(x))
        lang_of, seed_of = np.array([names[x] for x in b.column("lang").to_pylist()], np.int64), np.array(seeds, U)
        for codes, at, own in windows(b.column("text").to_pylist()):
            lang = lang_of[own]
            found, place, which = _distinct(_prints(codes, at, seed_of[lang]))
            held.append((found, codes[at[place]], lang[place], np.bincount(which, minlength=len(found))))
            rows += len(found)
            if rows > _HELD:
                merge()
                rows = len(held[0][0])
                if rows > _HELD // 2:
                    yield counted()
                    held.clear()
                    rows = 0
    if held:
        merge()
        yield counted()


def train(trusted: DataFrame) -> DataFrame:
    """Model of ``trusted`` (lang, text): rows (lang, gram, context, weight, raw).

    A row says what log2 probability an n-gram adds (context false), or what it adds as the context of a character
    (context true; the empty one is there for every character), and how often it occurs. Orders below the highest
    count in how many contexts an n-gram continues.
    """
    counts = stored(trusted.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("raw", F.col("n")))
    seen = {}
    for k in range(ORDER, 0, -1):
        d = counts.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("different"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # a count of counts may be empty in a tiny corpus: half a count is then taken off (greatest and least pass over nulls)
        raw = lambda i: i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        cut = lambda i: F.when(raw(i).isNull(), 0.5).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), raw(i))))
        d = stored(d.select("lang", "different", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)]))  # a row for each language; stored, so that the planner knows its size
        grams = counts.join(d, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        grams = grams.select("lang", "gram", F.substring("gram", 1, k - 1).alias("before"), "n", "raw", "d", "different")
        contexts = grams.groupBy("lang", "before").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"), F.sum("raw").alias("used"))
        joined = grams.join(contexts, ["lang", "before"]).select("lang", "gram", "before", "raw", "used", "different", ((F.col("n") - F.col("d")) / F.col("total")).alias("mass"), (F.col("cut") / F.col("total")).alias("rest"))
        seen[k] = stored(joined)
        if k > 1:
            counts = stored(counts.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw")))
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        if k == 1:  # below all orders every character, and one never seen, is as likely
            level = seen[1].withColumn("rest", F.col("rest") / (F.col("different") + 1)).withColumn("p", F.col("mass") + F.col("rest")).withColumn("weight", F.log2("p") - F.log2("rest"))
        else:
            level = seen[k].withColumn("end", F.substring("gram", 2, k - 1)).join(lower, ["lang", "end"])
            level = level.withColumn("p", F.col("mass") + F.col("rest") * F.col("low")).withColumn("weight", F.log2("p") - F.log2("rest") - F.log2("low"))
        level = stored(level.select("lang", "gram", "before", "raw", "used", "rest", "p", "weight"))
        lower = level.select("lang", F.col("gram").alias("end"), F.col("p").alias("low"))
        parts.append(level.select("lang", "gram", F.lit(False).alias("context"), "weight", "raw"))
        rests = level.groupBy("lang", "before").agg(F.log2(F.max("rest")).alias("weight"), F.max("used").alias("raw"))
        parts.append(rests.select("lang", F.col("before").alias("gram"), F.lit(True).alias("context"), "weight", "raw"))
    return reduce(DataFrame.unionByName, parts)


def _chain(seed: np.ndarray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of what the rows of ``codes`` end with: nothing, the last character, the last two, ..."""
    yield seed
    for k in range(codes.shape[1] - 1, -1, -1):
        seed = mix(seed * _STEP + codes[:, k].astype(U))
        yield seed


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seed = np.array([_seed(x) for x in b.column("lang").to_pylist()], U)
        seed = np.where(b.column("context").to_numpy(zero_copy_only=False), mix(seed ^ _CONTEXT), seed)
        grams = b.column("gram").to_pylist()
        size, key = np.array([len(g) for g in grams], np.int64), seed.copy()
        for n in range(1, ORDER + 1):
            own = np.flatnonzero(size == n)
            if len(own):
                codes = np.frombuffer("".join([grams[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                *_, key[own] = _chain(seed[own], codes)
        yield pa.record_batch([pa.array(key.astype(np.int64)), b.column("weight"), b.column("raw")], names=["key", "weight", "raw"])


def _bits(key):
    """The two bits of a key in the sieve."""
    return (key >> U(64 - SIEVE)).astype(np.int64), (key & U((1 << SIEVE) - 1)).astype(np.int64)


class Weights:
    """A model ready for use: ``sent`` is broadcast (sorted keys, their weights, the sieve), ``rest`` (key, weight) is joined."""

    def __init__(self, model: DataFrame) -> None:
        keyed = stored(model.mapInArrow(_keyed, "key long, weight double, raw long"))
        level = F.floor(F.log2("raw") * 16)
        sizes = keyed.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # some hundred rows, whatever the model
        total = least = None
        for r in sizes:
            total = (total or 0) + r["n"]
            if total > HOT:
                break
            least = r["level"]
        hot = keyed.where(level >= least) if least is not None else keyed.where("false")
        self.rest = keyed.where(level < least if least is not None else F.lit(True)).select("key", "weight")
        table = hot.select("key", F.col("weight").cast("float").alias("weight")).toArrow()
        key, weight = table.column("key").to_numpy().astype(U), table.column("weight").to_numpy()
        order = np.argsort(key)
        # 64 bits to a row: at most 2 ** (SIEVE - 6) rows come out, whatever the model
        low = F.lit((1 << SIEVE) - 1)
        bit = F.explode(F.array(F.shiftrightunsigned("key", 64 - SIEVE), F.col("key").bitwiseAND(low))).alias("bit")
        words = self.rest.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("mask")).toArrow()
        sieve = np.zeros(1 << (SIEVE - 6), np.int64)
        sieve[words.column("word").to_numpy()] = words.column("mask").to_numpy()
        self.sent = model.sparkSession.sparkContext.broadcast((key[order], weight[order].astype(np.float32), sieve.view(U)))


def _look(sent: tuple[np.ndarray, ...], key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of each key (0 if it isn't hot), whether it is hot, and whether it may be among the others."""
    keys, weights, sieve = sent
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hot = keys[at] == key
        weight = np.where(hot, weights[at], np.float32(0))
    else:
        hot, weight = np.zeros(len(key), bool), np.zeros(len(key), np.float32)
    one, two = _bits(key)
    set_ = lambda x: (sieve[x >> 6] >> (x & 63).astype(U)) & U(1)
    return weight, hot, ~hot & ((set_(one) & set_(two)) == 1)


def _weigh(sent: tuple[np.ndarray, ...], seed: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the hot weights of each row, and (row, key) of what else it may have in the model."""
    total = np.zeros(len(codes))
    rows, keys = [], []
    for start, part in ((seed, codes), (mix(seed ^ _CONTEXT), codes[:, :-1])):
        alive = np.arange(len(codes))
        for k, key in enumerate(_chain(start, part)):
            if not k and part is codes:
                continue
            weight, hot, may = _look(sent, key[alive])
            total[alive] += weight
            rows.append(alive[may])
            keys.append(key[alive[may]])
            # what has no entry has none either with a character before it
            alive = alive[hot | may]
    return total, np.concatenate(rows), np.concatenate(keys)


def _score(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent = weights.value
    # sums of rows of late, each in the place that its fingerprint names
    late, sums = np.zeros(1 << _LATE, U), np.zeros(1 << _LATE)
    number = TaskContext.get().partitionId() << 40
    for b in pieces(batches, "text"):
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        seeds = {x: _seed(x) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], U)
        bits = np.zeros(len(texts))
        cold: list[tuple[np.ndarray, ...]] = []
        for codes, at, own in windows(texts):
            h = _prints(codes, at, seed[own])
            slot = h >> U(64 - _LATE)
            hit = late[slot] == h
            bits += np.bincount(own, np.where(hit, sums[slot], 0), len(texts))
            miss = np.flatnonzero(~hit)
            own, at = own[miss], at[miss]
            found, place, which = _distinct(h[miss])
            total, row, key = _weigh(sent, seed[own[place]], codes[at[place]])
            bits += np.bincount(own, total[which], len(texts))
            whole = np.ones(len(found), bool)
            whole[row] = False
            slot = found[whole] >> U(64 - _LATE)
            late[slot], sums[slot] = found[whole], total[whole]
            if len(row):
                # by text: how often each row with keys to join stands there
                some = np.zeros(len(found), bool)
                some[row] = True
                some = np.flatnonzero(some[which])
                pair, n = np.unique(own[some] * len(found) + which[some], return_counts=True)
                text, unique = np.divmod(pair, len(found))
                order = np.argsort(row, kind="stable")
                first, last = np.searchsorted(row[order], unique, "left"), np.searchsorted(row[order], unique, "right")
                times = last - first
                take = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                cold.append((np.repeat(text, times), key[order][take], np.repeat(n, times)))
        base = mix(seed ^ _CONTEXT)
        text, key, n = (np.concatenate(x) for x in zip(*cold)) if cold else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
        order = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[order], np.arange(len(texts) + 1)).astype(np.int32)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order].astype(kind)))
        yield pa.record_batch(
            [
                b.column("row"),
                pa.array(langs, pa.string()),
                pa.array(np.arange(number, number + len(texts))),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(bits),
                pa.array(base.astype(np.int64)),
                pa.array(_look(sent, base)[1]),
                lists(key, np.int64),
                lists(n, np.int64),
            ],
            names=["row", "lang", "at", "n_symbols", "bits", "base", "known", "keys", "times"],
        )
        number += len(texts)


def perplexities(rows: DataFrame, weights: Weights) -> DataFrame:
    """``rows`` (row, lang, text) to (row, lang, n_symbols, perplexity). A text without characters, or in a
    language without a model, has a null perplexity."""
    shape = with_fields(rows.select("row", "lang"), "at long, n_symbols long, bits double, base long, known boolean, keys array<long>, times array<long>")
    scored = stored(rows.mapInArrow(partial(_score, weights.sent), shape))
    asked = scored.where(F.size("keys") > 0).select("at", "base", F.explode(F.arrays_zip("keys", "times")).alias("x"))
    asked = asked.select("at", "base", F.col("x.keys").alias("key"), F.col("x.times").alias("n"))
    more = asked.join(weights.rest, "key").groupBy("at").agg(F.sum(F.col("n") * F.col("weight")).alias("more"), F.max(F.col("key") == F.col("base")).alias("has"))
    all_ = scored.select("row", "lang", "at", "n_symbols", "bits", "known").join(more, "at", "left")
    bits = (F.col("bits") + F.coalesce("more", F.lit(0.0))) / (F.col("n_symbols") + 1)
    value = F.when((F.col("n_symbols") > 0) & (F.col("known") | F.coalesce("has", F.lit(False))), F.pow(F.lit(2.0), -bits))
    return all_.select("row", "lang", "n_symbols", value.alias("perplexity"))


QUANTILE = 0.999
#: Held-out texts without which a language has no limit of its own.
FEWEST = 20


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with the flag ``trusted``."""
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"), F.count(F.when(F.col("quality").isNull() | F.col("toxic").isNull(), 1)).alias("gaps"))
    # stored, so that the planner knows their size and chooses the join
    ids = stored(ids.where("q = 1 and x = 0 and gaps = 0").select(F.col("doc_id").alias("_id"), F.lit(True).alias("trusted")))
    return docs.join(ids, F.col(id_col) == F.col("_id"), "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def _rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, row) -> DataFrame:
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _trusted(rows, labels, "id").select("row", "trusted", "lang", "text")


def _judged(rows: DataFrame, quantile: float) -> DataFrame:
    """``rows`` (row, trusted, lang, text) to (row, lang, n_symbols, perplexity, limit)."""
    held = F.col("trusted") & (F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    weights = Weights(train(rows.where(F.col("trusted") & ~held).select("lang", "text")))
    scored = stored(perplexities(rows.select(F.struct("row", held.alias("held")).alias("row"), "lang", "text"), weights))
    limits = scored.where("row.held and perplexity is not null").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("limit"), F.count("*").alias("n"))
    limits = stored(limits.where(F.col("n") >= FEWEST).select("lang", "limit"))
    widest = limits.agg(F.max("limit")).first()[0]
    limit = F.when(F.col("perplexity").isNotNull(), F.coalesce("limit", F.lit(widest).cast("double")))
    return scored.join(limits, "lang", "left").select("row.row", "lang", "n_symbols", "perplexity", limit.alias("limit"))


def _accepted():
    return (F.col("n_symbols") > 0) & (F.col("perplexity").isNull() | F.col("limit").isNull() | (F.col("perplexity") <= F.col("limit")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, n_symbols, perplexity, limit, accepted): a row for each row of ``docs``.

    Trusted are the documents with labels (doc_id, quality, toxic) that all say quality 1 and toxic 0. A fifth
    of them, by hash of the text, is held out of the model. A document is accepted if its perplexity is at most the
    ``quantile`` of the held-out documents of its language; a language with fewer than ``FEWEST`` of
    these takes the widest limit of the others, and without any limit texts are accepted. So is a text in a language without
    trusted documents, which has no perplexity. Null text is the empty text; a text without characters isn't accepted. A null
    language counts as the language "". Rows that repeat an id each get a result; other columns are ignored.
    """
    rows = _rows(docs, labels, id_col, text_col, lang_col, F.struct(id_col))
    return _judged(rows, quantile).select("row.*", "lang", "n_symbols", "perplexity", "limit", _accepted().alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``classify`` accepts.

    Rows are told apart by language and text, on which alone the verdict depends: the fingerprints of rejected texts are joined with the rows.
    """
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    prints = F.struct(F.xxhash64(lang, text).alias("one"), F.xxhash64(F.lit("second"), lang, text).alias("two"))
    judged = _judged(_rows(docs, labels, id_col, text_col, lang_col, prints), quantile)
    out = stored(judged.where(~_accepted()).select("row").distinct())
    return docs.select(F.struct("*").alias("whole"), prints.alias("row")).join(out, "row", "left_anti").select("whole.*")
