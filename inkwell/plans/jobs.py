"""Jobs put together from operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.dates import cutoff
from inkwell.operators.counting import kst, known


def daily_counts(traffic: DataFrame, at: str) -> DataFrame:
    return traffic.groupBy(F.to_date(kst(at)).alias("day")).agg(F.count("*").alias("n"))


def dashboard(traffic: DataFrame) -> DataFrame:
    """(panel, label, n): counts by category and by Korean day and the total, in one pass."""
    rows = traffic.select(known("bot_category").alias("category"), F.to_date(kst("accessed_at")).cast("string").alias("day"))
    sets = rows.groupingSets([[F.col("category")], [F.col("day")], []], F.col("category"), F.col("day")).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    panel = F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "day").otherwise("total")
    return sets.select(panel.alias("panel"), F.when(F.col("_g") == 3, "rows").otherwise(F.coalesce("category", "day")).alias("label"), "n")


@dataclass(frozen=True)
class RetentionRule:
    """Rows of ``table`` (id, ``basis``) that ``guard`` lets go, ``days`` after ``basis``: what happens to them, and to how many in a run."""

    key: str
    table: str
    action: str
    days: int
    basis: str
    guard: Column | None = None
    batch: int = 500


def retention(tables: dict[str, DataFrame], rules: Sequence[RetentionRule], now: Column) -> DataFrame:
    """(rule, action, id): what a run does, of each rule the oldest rows that are due, up to its batch. A row without the moment that a rule counts from stays."""
    found = [_due(tables[r.table], r, now).orderBy(r.basis, "id").limit(r.batch).select(F.lit(r.key).alias("rule"), F.lit(r.action).alias("action"), "id") for r in rules]
    return reduce(DataFrame.unionByName, found)


def retention_report(tables: dict[str, DataFrame], rules: Sequence[RetentionRule], now: Column) -> DataFrame:
    """(rule, due, acted, left): how many rows are due under each rule, and how many a run leaves for the next."""
    counts = [_due(tables[r.table], r, now).agg(F.lit(r.key).alias("rule"), F.count("*").alias("due"), F.least(F.lit(r.batch), F.count("*")).cast("long").alias("acted")) for r in rules]
    return reduce(DataFrame.unionByName, counts).withColumn("left", F.col("due") - F.col("acted"))


def _due(rows: DataFrame, rule: RetentionRule, now: Column) -> DataFrame:
    due = rows.where(F.col(rule.basis) < cutoff(now, F.lit(rule.days)))
    return due if rule.guard is None else due.where(rule.guard)


def scarcest(knowledge: DataFrame, k: int) -> DataFrame:
    rest = F.sum(F.greatest(F.lit(0), 3 - F.col("use_count"))).alias("remaining")
    return knowledge.groupBy("area").agg(rest).orderBy("remaining", "area").limit(k)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    lost = child.select(F.col(fk).alias("_k")).join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def hourly_operations(calls: DataFrame, slots: DataFrame, existing: DataFrame, at: str) -> DataFrame:
    """(run, calls, scheduled): calls (id, ``at``: UTC) of an hourly job. The first call of an hour is its run, the others are skipped. A run schedules every slot (slot, weekday, hour,
    even_weeks) of its Korean day that is due by its hour and has no work yet: neither one of ``existing`` (schedule_key) nor of an earlier run."""
    runs = calls.groupBy(F.date_trunc("hour", at).alias("run")).agg(F.count("*").alias("calls"))
    day = kst("run")
    due = runs.select("run", F.to_date(day).alias("day"), F.hour(day).alias("_now"), (F.dayofweek(day) - 1).alias("weekday")).join(F.broadcast(slots), "weekday")  # a week's slots
    due = due.where((F.col("hour") <= F.col("_now")) & (~F.col("even_weeks") | (F.weekofyear("day") % 2 == 0)))
    keys = due.groupBy(F.concat_ws("-", F.date_format("day", "yyyy-MM-dd"), "slot").alias("schedule_key")).agg(F.min("run").alias("run"))
    new = keys.join(existing.select("schedule_key").distinct(), "schedule_key", "left_anti").groupBy("run").agg(F.count("*").alias("scheduled"))
    return runs.join(new, "run", "left").select("run", "calls", F.coalesce("scheduled", F.lit(0).cast("long")).alias("scheduled"))
