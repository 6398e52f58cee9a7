"""Sliding-window rate limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _check(recent: deque, at: int, limit: int, window_ms: int) -> tuple[bool, int]:
    """Whether a hit passes, and seconds to wait; one that doesn't pass isn't counted."""
    while recent and recent[0] <= at - window_ms:
        recent.popleft()
    if len(recent) >= limit:
        return False, max(1, -(-(recent[0] + window_ms - at) // 1000))
    recent.append(at)
    return True, 0


def limited(hits: DataFrame, id_col: str, limit: int, window_ms: int) -> DataFrame:
    """hits (key, id, at_ms) to (key, id, allowed, retry_after): at most ``limit`` passes in any window of a key.
    A verdict hangs on those of the window before it, so a key is cut where it is quiet for a window: each piece is one task's, which streams through
    it in order and holds no more than the last passes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, recent = None, deque()
        for part in parts:
            found = []
            for k, n, at in zip(part["key"], part["piece"], part["at_ms"]):
                if (k, n) != piece:
                    piece, recent = (k, n), deque()
                found.append(_check(recent, int(at), limit, window_ms))
            yield pd.DataFrame({"key": part["key"], id_col: part[id_col], "allowed": [f[0] for f in found], "retry_after": [f[1] for f in found]})

    order = Window.partitionBy("key").orderBy("at_ms", id_col)
    quiet = (F.col("at_ms") - F.lag("at_ms").over(order) >= window_ms).cast("int")
    cut = hits.withColumn("quiet", F.coalesce(quiet, F.lit(0))).withColumn("piece", F.sum("quiet").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("quiet")
    ordered = cut.repartition("key", "piece").sortWithinPartitions("key", "piece", "at_ms", id_col)
    return ordered.mapInPandas(run, f"key string, {id_col} long, allowed boolean, retry_after int")


def limited_stream(hits: DataFrame, id_col: str, limit: int, window_ms: int) -> DataFrame:
    """As ``limited``, on a stream: the passes of the last window are the state of a key. A key that is quiet for a window and a
    minute loses its state: none of its passes count any more."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [])
        for part in parts:
            part = part.sort_values(["at_ms", id_col])
            found = [_check(recent, int(a), limit, window_ms) for a in part["at_ms"]]
            yield pd.DataFrame({"key": part["key"], id_col: part[id_col], "allowed": [f[0] for f in found], "retry_after": [f[1] for f in found]})
        state.update((list(recent),))
        state.setTimeoutDuration(window_ms + 60_000)

    shape = f"key string, {id_col} long, allowed boolean, retry_after int"
    return hits.groupBy("key").applyInPandasWithState(run, shape, "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
