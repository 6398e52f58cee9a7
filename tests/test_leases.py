"""The lease queue: a log replayed against a plain reading of the rules, and the stream against the replay."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.queries import QUERIES
from inkwell.queries.state import lease_events
from inkwell.sources.views import Tables
from inkwell.streaming import leases

from .conftest import DATA

HOUR = 3_600_000_000


def plain(events, lease, most, until):
    """Every job has a state; each event looks at all of them."""
    out, jobs, n = [], {}, 0

    def end(now):
        for j in sorted((j for j in jobs.values() if j["state"] == "leased" and j["ends"] <= now), key=lambda j: (j["ends"], j["id"])):
            back(j, j["ends"], "expired")

    def back(j, at, action):
        j["state"] = "gone" if j["attempts"] >= most else "waiting"
        out.append((at, j["id"], j["worker"], "exhausted" if j["state"] == "gone" else action, j["attempts"]))

    for at, id_, kind, worker in events:
        end(at)
        own = sorted((j for j in jobs.values() if j["state"] == "leased" and j["worker"] == worker), key=lambda j: (j["claimed"], j["id"]))
        if kind == "submit":
            jobs[id_] = {"id": id_, "created": at, "attempts": 0, "state": "waiting", "worker": None}
        elif kind == "claim":
            free = sorted((j for j in jobs.values() if j["state"] == "waiting"), key=lambda j: (j["created"], j["id"]))
            if own:
                own[0]["ends"] = at + lease
                out.append((at, own[0]["id"], worker, "resumed", own[0]["attempts"]))
            elif free:
                j = free[0]
                action = "taken" if j["worker"] in (None, worker) else "stolen"
                j.update(state="leased", worker=worker, attempts=j["attempts"] + 1, claimed=at, ends=at + lease)
                out.append((at, j["id"], worker, action, j["attempts"]))
        elif kind == "heartbeat":
            for j in own:
                j["ends"] = at + lease
        elif own and kind == "done":
            own[0]["state"] = "gone"
            out.append((at, own[0]["id"], worker, "done", own[0]["attempts"]))
        elif own and kind == "fail":
            back(own[0], at, "failed")
    end(until)
    return out


@pytest.fixture(scope="module")
def events(spark):
    return lease_events(Tables(spark, str(DATA)))


def test_replay_follows_the_rules(spark, events):
    rows = events.withColumn("us", F.unix_micros("at")).orderBy("us", "id").collect()
    want = Counter()
    for q in {r["queue"] for r in rows}:
        want.update((q, *x) for x in plain([(r["us"], r["id"], r["kind"], r["worker"]) for r in rows if r["queue"] == q], 2 * HOUR, 3, 1_706_659_200_000_000))
    out = QUERIES["T04_lease_replay"](spark, str(DATA)).withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).collect()
    assert Counter((r["queue"], r["us"], r["job"], r["worker"], r["action"], r["attempts"]) for r in out) == want
    assert {r["action"] for r in out} == {"taken", "stolen", "resumed", "expired", "done", "failed", "exhausted"}


def test_stream_agrees_with_the_replay(spark, events, tmp_path):
    """The table comes in pieces by time; leases end by timers as the watermark moves."""
    rows = events.withColumn("day", F.floor(F.dayofmonth("at") / 6))
    for k in range(6):
        rows.where(F.col("day") == k).drop("day").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # an hour after the last event, in a queue of its own, the watermark passes all before
    last = events.agg(F.max("at")).first()[0]
    late = spark.createDataFrame([("other", 0, "heartbeat", "w0")], "queue string, id long, kind string, worker string").select("queue", (F.lit(last) + F.expr("INTERVAL 1 HOUR")).alias("at"), "id", "kind", "worker")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    name, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = leases.stream(source, "1 second", 7200).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, was)
    mark = int(last.timestamp() * 1_000_000) + HOUR - 1_000_000
    got = Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").withColumn("at", F.unix_micros("at")).where(F.col("at") < mark - 1000).collect()))
    want = Counter(map(tuple, leases.replay(events, mark, 7200).withColumn("at", F.unix_micros("at")).where(F.col("at") < mark - 1000).collect()))
    assert got == want and want
