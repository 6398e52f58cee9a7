"""Append logs and windowed counts over streams of events (ts: timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The log as Parquet by Korean day; what is there is written once and the query ends."""
    rows = events.withColumn("day", F.to_date(F.col("ts") + F.expr("INTERVAL 9 HOURS")))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of each Korean day; rows more than ``late`` behind are dropped from closed days."""
    at = F.window("ts", "1 day", startTime="15 hours")
    return events.withWatermark("ts", late).groupBy(at, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
