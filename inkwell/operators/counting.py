"""Counts and shares by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(name: str, otherwise: str = "unknown") -> Column:
    """The column, with null and empty as ``otherwise``."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(otherwise))


def kst(name: str) -> Column:
    """A UTC timestamp as Korean local time (no daylight saving)."""
    return F.col(name) + F.expr("INTERVAL 9 HOURS")


def count_by(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*[known(n).alias(n) for n in names]).agg(F.count("*").alias("n"))


def counts_of_each(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(dimension, value, n): group counts of each column, in one pass by grouping sets."""
    rows = df.select(*[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")).alias(n) for n, c in columns.items()])
    sets = rows.groupingSets([[F.col(n)] for n in columns], *[F.col(n) for n in columns]).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    bit = {n: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - k)) for k, n in enumerate(columns)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, g in bit.items():
        name, value = F.when(F.col("_g") == g, n).otherwise(name), F.when(F.col("_g") == g, F.col(n)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def top(df: DataFrame, k: int, by: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows by ``by``, of each group where ``within`` names one."""
    if not within:
        return df.orderBy(*by).limit(k)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("_r") <= k).drop("_r")


def top_and_other(counts: DataFrame, name: str, k: int) -> DataFrame:
    """(name, n, share, start): the ``k`` largest and the rest as "other", in order, with the share of the
    total and the share before it."""
    # the ranking is over groups, of which there are few
    ranked = counts.withColumn("_r", F.least(F.row_number().over(Window.orderBy(F.desc("n"), name)), F.lit(k + 1)))
    slices = ranked.groupBy("_r").agg(F.when(F.col("_r") > k, "other").otherwise(F.min(name)).alias(name), F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    before = F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slices.select(name, "n", F.round(F.col("n") / total, 6).alias("share"), F.round(before / total, 6).alias("start"))


def complete(counts: DataFrame, grid: DataFrame, *keys: str) -> DataFrame:
    """A row for each row of the small ``grid``, with 0 where ``counts`` (keys, n) has none."""
    return grid.join(counts, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
