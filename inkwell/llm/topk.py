"""Exact top-k search by exhaustive term-at-a-time accumulation.

A component of a vector is a term with an integer weight. In each task the candidates become postings:
per term, the rows that hold it and their weights. The queries are taken term by term; each scatters its
weights times the postings into a dense array of scores, query by row. When all terms are through, the
``k`` best of each query are selected by partition, merged with those of earlier rows, and at last
with those of the other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import release, stored

#: Queries in a block, about (by hash); each block is broadcast and meets all candidates in its own pass.
BLOCK = 2048
_ROWS = 2048
_MOST = (1 << 63) - 1


def weights(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all components that aren't 0, of valid vectors."""
    column = column.cast(pa.list_(pa.float64()))
    flat, ends = column.flatten(), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()) if len(column) else [])]).astype(int)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    x = flat.to_numpy(zero_copy_only=False)
    large = np.abs(x) >= 2.0**53  # whole numbers; times 256 they may be beyond a double
    value = np.floor(256.0 * np.where(large, 1.0, x))
    term = np.arange(len(value)) - ends[row]
    some = np.flatnonzero(value)
    if large.any() or len(some) and np.abs(value[some]).max() >= 2.0**62:
        value = np.array([256 * int(x[k]) if large[k] else int(value[k]) for k in some], object)
    else:
        value = value[some].astype(np.int64)
    return row[some], term[some], value


class Queries:
    """A block of queries: ids, fingerprints of their vectors, and the postings of their terms."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        self.ids, self.prints = table.column("vec_id").to_numpy(), table.column("print").to_numpy()
        self.rows, self.terms, self.values = weights(table.column("embedding").combine_chunks())


def _postings(rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    return {int(t): (rows[o], values[o]) for t, o in zip(names, np.split(order, first[1:]))}


def scores(queries: Queries, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Inner products, (queries, n); exact."""
    top = lambda v: max((abs(int(x)) for x in (v.min(), v.max())), default=0) if len(v) else 0
    bound = top(queries.values) * top(values) * max(1, len(np.unique(terms)))
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    out = np.zeros((len(queries.ids), n), kind)
    own = _postings(queries.rows, queries.terms, queries.values)
    for term, (row, value) in _postings(rows, terms, values).items():
        if term in own:
            asked, weight = own[term]
            part = weight.astype(kind)[:, None] * value.astype(kind)[None, :]
            if len(asked) == len(out) and len(row) == n:
                out += part
            else:
                out[np.ix_(asked, row)] += part
    return out


def _best(score: np.ndarray, ids: np.ndarray, prints: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of one query: by score, then smaller id."""
    near = np.arange(len(score))
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return near[np.lexsort((prints[near], ids[near], -score[near]))][:k]


def _search(queries, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q = queries.value
    n = len(q.ids)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            b = batch.slice(start, _ROWS)
            ids, prints = b.column("vec_id").to_numpy(), b.column("print").to_numpy()
            score = scores(q, *weights(b.column("embedding")), len(ids))
            if score.dtype == object:
                score = np.clip(score, -_MOST - 1, _MOST)
            score = score.astype(np.int64)
            floor = np.array([x[0][-1] if len(x[0]) == k else -_MOST - 1 for x in best])
            for i in np.flatnonzero(score.max(axis=1, initial=-_MOST - 1) >= floor).tolist():
                at = np.flatnonzero(score[i] >= floor[i])
                s, v, p = (np.concatenate(x) for x in zip(best[i], (score[i, at], ids[at], prints[at])))
                top = _best(s, v, p, k)
                best[i] = (s[top], v[top], p[top])
    for start in range(0, n, 4096):
        part = best[start : start + 4096]
        times = [len(x[0]) for x in part]
        if sum(times):
            at = np.repeat(np.arange(start, start + len(part)), times)
            s, v, p = (np.concatenate(x) for x in zip(*part))
            yield pa.record_batch([pa.array(x) for x in (q.ids[at], q.prints[at], v, p, s)], names=["query_id", "query_print", "vec_id", "print", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest score for each row that ``is_query`` selects.

    ``vectors`` has vec_id and embedding (array of float or double); components x count as floor(256 * x),
    missing ones of a shorter vector as 0. A row is no candidate of its own; ties go to the smaller id.
    Rows without an id, and vectors null or with a null or non-finite component, take no part. Rows that
    repeat an id, or id and vector, are rows like any other: each is found by itself, by its copies too, and each that is a query has its own results, so those of
    equal queries come once for each. Scores beyond a long are its nearest value. With no other row there is no result.
    """
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("print", F.xxhash64("embedding"))
    asked = stored(rows.where(is_query).groupBy("vec_id", "print").agg(F.any_value("embedding").alias("embedding"), F.count("*").alias("times")))
    n = -(-asked.count() // BLOCK)
    done, held = None, []
    for j in range(n):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "print"), F.lit(n)) == j).toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(Queries(block))
        part = _ranked(rows.mapInArrow(partial(_search, sent, k + 1), "query_id long, query_print long, vec_id long, print long, score long"), k)
        if j < n - 1:
            # one block at a time is in the driver and on the executors; results are few, and gather in one stored table
            part = stored(part)
            sent.destroy()
            if done is not None and j % 16 == 15:
                whole = stored(done.unionByName(part))
                release(*held, part)
                done, held = whole, [whole]
                continue
            held.append(part)
        done = part if done is None else done.unionByName(part)
    if done is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    again = asked.where("times > 1").select(F.col("vec_id").alias("query_id"), F.col("print").alias("query_print"), "times")
    met = done.join(again, ["query_id", "query_print"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
    return met.select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best without the query's own row. What was searched holds it: of rows like it one is left out, if it is among the ``k`` + 1 best."""
    query = Window.partitionBy("query_id", "query_print")
    best = found.withColumn("place", F.row_number().over(query.orderBy(F.desc("score"), "vec_id", "print"))).where(F.col("place") <= k + 1)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("print") == F.col("query_print")), F.col("place"))).over(query)
    best = best.withColumn("own", F.coalesce(own, F.lit(k + 2))).where(F.col("place") != F.col("own"))
    best = best.withColumn("rank", F.when(F.col("place") > F.col("own"), F.col("place") - 1).otherwise(F.col("place")))
    return best.where(F.col("rank") <= k).select("query_id", "query_print", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, q.row AS own, c.vec_id,
           list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.row <> c.row
    WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
