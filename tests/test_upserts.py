"""Upserts from a stream: killed between the write and the ledger, delivered again, and delivered with other rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.operators import upsert
from inkwell.streaming.upserts import ConflictError, UpsertTable

from .conftest import DATA

SCHEMA = "user_id long, event_id long, event_type string, ts timestamp_ntz"


def merge(target, batch):
    return upsert.last_wins(target, batch, ["user_id"], [F.col("ts"), F.col("event_id")])


def rows_of(df):
    return sorted(map(tuple, df.select("user_id", "event_id", "event_type").collect()))


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "event_type", "ts")


@pytest.fixture(scope="module")
def source(events, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("source"))
    for k in range(5):
        events.where(F.floor(F.dayofmonth("ts") / 7) == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, source, table, state):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = rows.writeStream.foreachBatch(table.apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def test_killed_between_write_and_ledger(spark, source, events, tmp_path, monkeypatch):
    table = UpsertTable(spark, f"{tmp_path}/users", SCHEMA, ["user_id"], merge, parts=4)
    commit, calls = table._commit, []

    def dies(entry):
        calls.append(entry[0])
        if calls.count(2) == 1 and entry[0] == 2:
            raise RuntimeError("killed")
        commit(entry)

    table._commit = dies
    with pytest.raises(Exception, match="killed"):
        run(spark, source, table, f"{tmp_path}/state")
    assert [e["batch"] for e in table.ledger()] == [0, 1]
    before = rows_of(table.read())
    run(spark, source, table, f"{tmp_path}/state")  # a new run goes on with the batch that was cut off
    assert calls.count(2) == 2 and before != rows_of(table.read())
    want = rows_of(upsert.last_wins(spark.createDataFrame([], SCHEMA), events, ["user_id"], [F.col("ts"), F.col("event_id")]))
    assert rows_of(table.read()) == want
    assert table.clean() >= 1 and rows_of(table.read()) == want

    # without its state the stream delivers all again: every batch is known
    n = len(table.ledger())
    run(spark, source, table, f"{tmp_path}/other")
    assert len(table.ledger()) == n and rows_of(table.read()) == want


def test_another_batch_of_one_number_is_a_conflict(spark, events, tmp_path):
    table = UpsertTable(spark, f"{tmp_path}/users", SCHEMA, ["user_id"], merge, parts=4)
    few = events.where("user_id < 3")
    table.apply(few, 0)
    table.apply(few.repartition(3), 0)
    once = rows_of(table.read())
    with pytest.raises(ConflictError):
        table.apply(few.withColumn("event_type", F.lit("x")), 0)
    table.apply(few.limit(0), 1)
    assert rows_of(table.read()) == once and [e["rows"] for e in table.ledger()] == [few.count(), 0]


def test_only_the_parts_of_a_batch_are_written(spark, events, tmp_path):
    table = UpsertTable(spark, f"{tmp_path}/users", SCHEMA, ["user_id"], merge, parts=16)
    table.apply(events, 0)
    table.apply(events.where("user_id = 5").withColumn("event_id", F.lit(10**9)).withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz")), 1)
    assert len(table.ledger()[1]["parts"]) == 1
    assert [r[:2] for r in rows_of(table.read()) if r[0] == 5] == [(5, 10**9)]
    assert {r[0] for r in rows_of(table.read())} == {r["user_id"] for r in events.select("user_id").distinct().collect()}


def test_conditional_upsert(spark, tmp_path):
    """Rows under a lease that holds stay as they are (the rule of S30)."""
    schema = "id long, status string, until long"

    def held(target, batch):
        rows = target.select("id", F.struct("status", "until").alias("old")).join(batch.select("id", F.struct("status", "until").alias("new")), "id", "full")
        keep = F.col("new").isNull() | F.coalesce((F.col("old.status") == "done") | (F.col("old.until") > F.col("new.until")), F.lit(False))
        return rows.select("id", F.when(keep, F.col("old")).otherwise(F.col("new")).alias("r")).select("id", "r.status", "r.until")

    table = UpsertTable(spark, f"{tmp_path}/jobs", schema, ["id"], held, parts=2)
    table.apply(spark.createDataFrame([(1, "done", 1), (2, "running", 9), (3, "running", 1)], schema), 0)
    table.apply(spark.createDataFrame([(k, "claimed", 5) for k in (1, 2, 3, 4)], schema), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, "done", 1), (2, "running", 9), (3, "claimed", 5), (4, "claimed", 5)]
