"""Toxicity by a chain of classifiers.

Features are the words of a text and the beginnings of its words, present or not. The categories are predicted in order, each by a
logistic regression whose inputs are the features and the probabilities of the categories before it. In training these
are out-of-fold: each document's comes from a model that was fitted, and whose features were chosen, without the document's fold. The
threshold of the verdict is set on out-of-fold probabilities, too.

The models are fitted on a bounded sample of labelled documents, one row for each id. Spark counts in how many documents of which fold and label
each feature stands; the driver gets the features chosen from these counts, and for each document of the sample which
of them it has: some MB, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import pieces, stored, with_fields
from ._words import U, Words, mix, words

#: Labelled documents of each kind (toxic, and not) that the models are fitted on, at most.
PER_CLASS = 3000
#: Features, by the strength of their tie to the category; word beginnings in bytes.
FEATURES, STEMS = 300, (4, 5, 6)
FOLDS, RIDGE = 5, 0.3
#: What the labels have: low_quality is the quality label 0, toxic the toxic label 1.
CATEGORIES = ("low_quality", "toxic")
#: A feature must be tied to its category with this strength (significance at 0.001 by itself), and more where there are many features.
LEAST = 10.8
_SIEVE = 18


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature fingerprints of all words and word beginnings, and the text of each."""
    own = w.owner()
    out, owner = [w.prints], [own]
    stem = np.zeros(len(w.starts), U)
    for k in range(max(STEMS)):
        at = w.starts + k
        inside = at < w.ends
        stem[inside] = (stem[inside] ^ w.data[at[inside]].astype(U)) * U(0x9E3779B97F4A7C15)
        if k + 1 in STEMS:
            longer = w.ends - w.starts > k + 1
            out.append(mix(stem[longer] + U(k + 1)))
            owner.append(own[longer])
    return np.concatenate(out), np.concatenate(owner)


def _once(found: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, feature) once."""
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    return found[new], own[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, cell, n): texts of a cell (fold and labels) that have the feature."""
    for b in pieces(batches, "text"):
        found, own = _once(*features(words(b.column("text"), marks=True)))
        cell = b.column("cell").to_numpy(zero_copy_only=False)[own]
        order = np.lexsort((found, cell))
        found, cell = found[order], cell[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        yield pa.record_batch([pa.array(found[at].astype(np.int64)), pa.array(cell[at], pa.int32()), pa.array(np.diff(np.append(at, len(found))), pa.int64())], names=["feature", "cell", "n"])


def _marked(keys: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, cell, bits): which of ``keys`` each text has."""
    for b in pieces(batches, "text"):
        found, own = features(words(b.column("text"), marks=True))
        x = _matrix(keys, found, own, b.num_rows)
        yield pa.record_batch([b.column("o"), b.column("cell"), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["o", "cell", "bits"])


def _matrix(keys: np.ndarray, found: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
    x = np.zeros((texts, len(keys)), bool)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        x[own[hit], at[hit]] = True
    return x


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))


class Chain:
    """The fitted chain. ``keys`` are the sorted fingerprints of its features.

    x: (document, candidate feature); fold: the fold of each document; chosen: for each fold the candidates chosen without it, and
    last those chosen from all.
    """

    def __init__(self, keys: np.ndarray, x: np.ndarray, labels: dict[str, np.ndarray], weight: np.ndarray, fold: np.ndarray, chosen: list[np.ndarray]) -> None:
        self.keys = keys[chosen[-1]]
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[self.keys >> U(64 - _SIEVE)] = True
        self.models: list[np.ndarray] = []
        self.prior = {c: float(np.average(y, weights=weight)) if len(y) else 0.0 for c, y in labels.items()}
        self.limit = 0.5
        before = np.zeros((len(x), 0))
        for c, y in labels.items():
            if 0 < y.sum() < len(y):
                out = np.full(len(x), self.prior[c])
                for k in range(FOLDS):
                    rest, own = fold != k, fold == k
                    if own.any() and 0 < y[rest].sum() < rest.sum():
                        inputs = np.hstack([x[:, chosen[k]], before])
                        out[own] = _predict(inputs[own], _fit(inputs[rest], y[rest].astype(float), weight[rest]))
                self.models.append(_fit(np.hstack([x[:, chosen[-1]], before]), y.astype(float), weight))
            else:
                out = np.full(len(x), self.prior[c])
                self.models.append(np.append(np.zeros(len(self.keys) + before.shape[1]), -30.0 if self.prior[c] < 0.5 else 30.0))
            if c == "toxic" and 0 < y.sum() < len(y):
                self.limit = _limit(out, y, weight)
            before = np.hstack([before, out[:, None]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        for beta in self.models:
            x = np.hstack([x, _predict(x, beta)[:, None]])
        return x[:, len(self.keys) :]

    def matrix(self, w: Words) -> np.ndarray:
        found, own = features(w)
        near = np.flatnonzero(self.sieve[found >> U(64 - _SIEVE)])
        return _matrix(self.keys, found[near], own[near], len(w.first) - 1)


def _limit(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which to call toxic: best F1 out of fold, in the middle of the gap there."""
    order = np.argsort(-p, kind="stable")
    hit, wrong = np.cumsum((weight * y)[order]), np.cumsum((weight * ~y)[order])
    f1 = 2 * hit / (hit + wrong + (weight * y).sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    best = int(np.argmax(f1))
    low = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + low) / 2)


def strength(n: Column, both: Column, docs: Column, positive: Column) -> Column:
    """G statistic of a feature that ``n`` of ``docs`` documents have, ``both`` of them among the ``positive`` ones of a category."""
    cells = [(both, n * positive), (n - both, n * (docs - positive)), (positive - both, (docs - n) * positive), (docs - positive - n + both, (docs - n) * (docs - positive))]
    parts = [F.when(o > 0, o * F.log(o * docs / e)).otherwise(0.0) for o, e in cells]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def choose(counts: DataFrame, cells: dict[int, int]) -> DataFrame:
    """(part, feature): the features of each part of the sample, which are all but one fold (part: that fold), and the whole (part ``FOLDS``).

    counts (feature, cell, n); cells: documents of each cell, fold * 4 + low_quality * 2 + toxic. Chosen are, for each category, the
    ``FEATURES`` of greatest strength, so at most 2 * ``FEATURES`` * (``FOLDS`` + 1) rows come out.
    """
    within = lambda cell, part, bit: cell // 4 != part and (bit is None or cell & bit > 0)
    total = lambda part, bit: float(sum(n for c, n in cells.items() if within(c, part, bit)))

    def had(part: int, bit: int | None) -> Column:
        inside = F.floor(F.col("cell") / 4) != part
        return F.sum(F.when(inside if bit is None else inside & (F.col("cell").bitwiseAND(bit) > 0), F.col("n")).otherwise(0)).cast("double")

    parts = range(FOLDS + 1)
    sums = counts.groupBy("feature").agg(*[had(p, bit).alias(f"n{p}_{bit or 0}") for p in parts for bit in (None, 2, 1)])
    sums = stored(sums.where(F.greatest(*[F.col(f"n{p}_0") for p in parts]) >= 3))
    # of n features that mean nothing some ten reach this
    sure = max(LEAST, 2 * float(np.log(max(sums.count(), 1))) - 8)
    scored = F.array(
        *[
            F.struct(F.lit(p).alias("part"), F.lit(bit).alias("bit"), strength(F.col(f"n{p}_0"), F.col(f"n{p}_{bit}"), F.lit(total(p, None)), F.lit(total(p, bit))).alias("g"), (F.col(f"n{p}_0") >= 3).alias("enough"))
            for p in parts
            for bit in (2, 1)
        ]
    )
    rows = sums.select("feature", F.explode(scored).alias("x")).select("feature", "x.*").where(F.col("enough") & (F.col("g") >= sure))
    place = F.row_number().over(Window.partitionBy("part", "bit").orderBy(F.desc("g"), "feature"))
    return rows.withColumn("r", place).where(F.col("r") <= FEATURES).select("part", "feature").distinct()


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """docs (o, text) and labels (doc_id, quality, toxic). Of labels that disagree the worse one holds; rows
    without a toxic label are left out, a null quality is 1. Of texts that share an id one trains, by hash."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("o")).agg(F.min(F.coalesce("quality", F.lit(1))).cast("long").alias("quality"), F.max("toxic").cast("long").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = one.where("toxic = 1").orderBy(F.xxhash64("o"), "o").limit(PER_CLASS).unionByName(one.where("toxic = 0").orderBy(F.xxhash64("o"), "o").limit(PER_CLASS))
    # each fold has its share of each combination of labels; the window is over the sample's ids alone
    turn = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy(F.xxhash64("o"), "o"))
    chosen = chosen.select("o", (turn % FOLDS * 4 + F.when(F.col("quality") == 0, 2).otherwise(0) + F.when(F.col("toxic") == 1, 1).otherwise(0)).cast("int").alias("cell"))
    # a row for each id, so that the sample is bounded whatever rows share an id
    rows = stored(docs.where("o is not null").join(F.broadcast(chosen), "o").groupBy("o", "cell").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")))
    cells = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    picked = choose(rows.select("cell", "text").mapInArrow(_counted, "feature long, cell int, n long"), cells).toArrow()
    part, feature = picked.column("part").to_numpy(), picked.column("feature").to_numpy().astype(U)
    keys = np.unique(feature)
    table = rows.mapInArrow(partial(_marked, keys), "o long, cell int, bits binary").toArrow().sort_by("o")
    cell = table.column("cell").to_numpy()
    width = -(-len(keys) // 8)
    x = np.unpackbits(np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(cell), width), axis=1)[:, : len(keys)].astype(bool) if width else np.zeros((len(cell), 0), bool)
    low, toxic = (cell & 2) > 0, (cell & 1) > 0
    sampled = {1: max(1, int(toxic.sum())), 0: max(1, int((~toxic).sum()))}
    weight = np.where(toxic, counts.get(1, 0) / sampled[1], counts.get(0, 0) / sampled[0])
    weight = weight / max(weight.mean(), 1e-12) if len(weight) else weight
    return Chain(keys, x, {"low_quality": low, "toxic": toxic}, weight, cell // 4, [np.searchsorted(keys, np.sort(feature[part == p])) for p in range(FOLDS + 1)])


def _score(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain = sent.value
    for b in pieces(batches, "text"):
        p = chain.predict(chain.matrix(words(b.column("text"), marks=True)))
        yield pa.record_batch([b.column("id"), *(pa.array(p[:, k]) for k in range(len(CATEGORIES))), pa.array(p[:, 1] >= chain.limit)], names=["id", *CATEGORIES, "is_toxic"])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, low_quality, toxic, is_toxic): probabilities and the verdict for each row of ``docs``.

    Null text is the empty text, which has no features. Without labels of both kinds the probabilities are the
    priors. Repeated rows each get a row; of those that share an id with a label, one trains.
    """
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    chain = train(docs.select(F.col(id_col).alias("o"), text.alias("text")), labels)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    shape = with_fields(rows.select("id"), ", ".join(f"{c} double" for c in CATEGORIES) + ", is_toxic boolean")
    return rows.mapInArrow(partial(_score, sent), shape).withColumnRenamed("id", id_col)
