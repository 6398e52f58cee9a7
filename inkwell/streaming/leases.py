"""Work queues with leases, as a stream of events and as a replay of a whole table.

An event (queue, at, id, kind, worker) is ``submit`` (a job, named by the event's id), ``claim``, ``heartbeat``, ``done`` or ``fail`` (of the
worker). What happens to jobs comes out as rows of ``SHAPE``. Both forms share ``Leases``; they differ in where a queue's state lies: in Spark's
state store, with a timer for each lease, or in the task that reads the queue in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SHAPE = "queue string, at timestamp, job long, worker string, action string, attempts int"
_LEASED = "leases array<struct<worker string, job long, created long, attempts int, claimed long, ends long>>, returned array<struct<created long, job long, attempts int, worker string>>, head long, tail long"


class Fifo(dict):
    """Jobs that wait since they came, by a running number."""

    put = dict.__setitem__
    take = dict.pop


class Leases:
    """The rules of one queue. ``waiting`` maps running numbers ``head..tail-1`` to new jobs; jobs given back wait in ``returned``, which like
    ``leases`` has no more entries than workers had leases."""

    def __init__(self, waiting: Any, lease_ms: int, most: int) -> None:
        self.waiting, self.lease_ms, self.most = waiting, lease_ms, most
        self.leases: list[list] = []
        self.returned: list[tuple] = []
        self.head = self.tail = 0
        self.out: list[tuple] = []

    def _say(self, at: int, job: int, worker: str | None, action: str, attempts: int) -> None:
        self.out.append((at, job, worker, action, attempts))

    def _give_back(self, lease: list, at: int, action: str) -> None:
        worker, job, created, attempts, _, _ = lease
        self.leases.remove(lease)
        if attempts >= self.most:
            return self._say(at, job, worker, "exhausted", attempts)
        heapq.heappush(self.returned, (created, job, attempts, worker))
        self._say(at, job, worker, action, attempts)

    def expire(self, now: int) -> None:
        """Leases that ended by now: their jobs wait again, or have failed where no attempt is left."""
        for lease in sorted((x for x in self.leases if x[5] <= now), key=lambda x: (x[5], x[1])):
            self._give_back(lease, lease[5], "expired")

    def event(self, at: int, id_: int, kind: str, worker: str) -> None:
        self.expire(at)
        own = sorted((x for x in self.leases if x[0] == worker), key=lambda x: (x[4], x[1]))
        if kind == "submit":
            self.waiting.put(self.tail, (at, id_))
            self.tail += 1
        elif kind == "claim" and own:  # a claim repeated after a lost answer
            own[0][5] = at + self.lease_ms
            self._say(at, own[0][1], worker, "resumed", own[0][3])
        elif kind == "claim":
            self._take(at, worker)
        elif kind == "heartbeat":
            for lease in own:
                lease[5] = at + self.lease_ms
        elif kind == "done" and own:
            self.leases.remove(own[0])
            self._say(at, own[0][1], worker, "done", own[0][3])
        elif kind == "fail" and own:
            self._give_back(own[0], at, "failed")

    def _take(self, at: int, worker: str) -> None:
        """The oldest job, by the time that it was submitted."""
        first = self.waiting.get(self.head) if self.head < self.tail else None
        if self.returned and (first is None or self.returned[0][:2] < tuple(first)):
            created, job, attempts, before = heapq.heappop(self.returned)
        elif first is not None:
            (created, job), attempts, before = first, 0, None
            self.waiting.take(self.head)
            self.head += 1
        else:
            return
        self.leases.append([worker, job, created, attempts + 1, at, at + self.lease_ms])
        self._say(at, job, worker, "taken" if before in (None, worker) else "stolen", attempts + 1)


def _rows(queue: str, out: list[tuple]) -> pd.DataFrame:
    at, job, worker, action, attempts = zip(*out) if out else ((),) * 5
    return pd.DataFrame({"queue": pd.Series([queue] * len(out), dtype=object), "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"), "job": pd.Series(job, dtype="int64"), "worker": pd.Series(worker, dtype=object), "action": pd.Series(action, dtype=object), "attempts": pd.Series(attempts, dtype="int32")})


def _micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


def replay(events: DataFrame, until_us: int, lease_seconds: int = 900, most: int = 3) -> DataFrame:
    """What happens to the jobs of a whole table of events; leases that end by ``until_us`` (microseconds) expire. A queue is
    sequential, so it is one task's, which streams through it in order of (at, id) and holds what waits."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, state = None, None
        for part in parts:
            for name, at, id_, kind, worker in zip(part["queue"], _micros(part["at"]), part["id"].tolist(), part["kind"], part["worker"]):
                if name != queue:
                    if state is not None:
                        state.expire(until_us)
                        yield _rows(queue, state.out)
                    queue, state = name, Leases(Fifo(), lease_seconds * 1_000_000, most)
                state.event(at, id_, kind, worker)
            if state is not None:
                yield _rows(queue, state.out)
                state.out.clear()
        if state is not None:
            state.expire(until_us)
            yield _rows(queue, state.out)

    rows = events.select("queue", "at", "id", "kind", "worker")
    return rows.repartition("queue").sortWithinPartitions("queue", "at", "id").mapInPandas(run, SHAPE)


class _Stored:
    """The waiting jobs in the state store: only the entries touched are read or written."""

    def __init__(self, jobs) -> None:
        self.jobs = jobs

    def put(self, number: int, job: tuple[int, int]) -> None:
        self.jobs.updateValue((number,), job)

    def get(self, number: int) -> tuple[int, int] | None:
        found = self.jobs.getValue((number,))
        return (int(found[0]), int(found[1])) if found is not None else None

    def take(self, number: int) -> None:
        self.jobs.removeKey((number,))


class LeaseProcessor(StatefulProcessor):
    """The state of a queue: its leases as a value, its waiting jobs as a map, and an event-time timer for the end of each lease."""

    def __init__(self, lease_seconds: int, most: int) -> None:
        self.lease_ms, self.most = lease_seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("queue", _LEASED)
        self.jobs = handle.getMapState("waiting", "number long", "created long, job long")

    def _open(self) -> Leases:
        state = Leases(_Stored(self.jobs), self.lease_ms, self.most)
        if self.value.exists():
            leases, returned, state.head, state.tail = self.value.get()
            state.leases = [list(x) for x in leases]
            state.returned = [tuple(x) for x in returned]
            heapq.heapify(state.returned)
        return state

    def _close(self, state: Leases) -> None:
        self.value.update(([tuple(x) for x in state.leases], state.returned, state.head, state.tail))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._open()
        part = pd.concat(list(rows)).sort_values(["at", "id"])
        known = {x[5] for x in state.leases}
        for at, id_, kind, worker in zip(_micros(part["at"]), part["id"].tolist(), part["kind"], part["worker"]):
            state.event(at, id_, kind, worker)
        for end in {x[5] for x in state.leases} - known:
            self.handle.registerTimer(-(-end // 1000))  # timers count milliseconds
        self._close(state)
        yield _rows(key[0], state.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._open()
        state.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._close(state)
        yield _rows(key[0], state.out)

    def close(self) -> None:
        pass


def stream(events: DataFrame, late: str = "1 minute", lease_seconds: int = 900, most: int = 3) -> DataFrame:
    """As ``replay``, on a stream (at: timestamp). Events of a micro-batch are put in order; one that comes after later ones of its queue counts
    when it comes, and one later than ``late`` is dropped. The RocksDB state store must be on."""
    rows = events.select("queue", "at", "id", "kind", "worker").withWatermark("at", late)
    return rows.groupBy("queue").transformWithStateInPandas(LeaseProcessor(lease_seconds, most), SHAPE, "Append", "EventTime")
