"""Inserts and updates as copy-on-write: the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(target: DataFrame, source: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with the same key. Of source rows with one key the last by ``order`` wins; ties, and
    rows without an order, go by the greatest row."""
    rows = target.withColumn("_rank", F.lit(0)).unionByName(source.withColumn("_rank", F.lit(1)))
    ties = [F.col(c).desc_nulls_last() for c, kind in target.dtypes if c not in key and not kind.startswith(("map", "variant"))]
    last = Window.partitionBy(*key).orderBy(F.desc("_rank"), *[c.desc_nulls_last() for c in order or []], *ties)
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_rank")


def first_wins(target: DataFrame, source: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``source`` whose key is new are added, one for each key: the first by ``order``, ties and rows without an order by the least row."""
    new = source.select(*target.columns).join(target, key, "left_anti")
    ties = [F.col(c).asc_nulls_last() for c, kind in target.dtypes if c not in key and not kind.startswith(("map", "variant"))]
    return target.unionByName(first_seen(new, key, [*(order or []), *ties] or [F.lit(0)]))


def update_columns(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full merge that takes ``columns`` from ``source`` wherever it has the key, nulls too; new keys are added. Keys are unique on
    either side, as an upsert needs."""
    new = source.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    met = target.join(new, key, "full")
    return met.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """``UPDATE ... FROM``: ``values`` (over both sides) where a row of ``source`` matches."""
    met = target.join(source.withColumn("_hit", F.lit(True)), key, "left")
    return met.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def first_seen(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def latest(df: DataFrame, key: list[str], at: str, *ties: Column) -> DataFrame:
    return first_seen(df, key, [F.desc_nulls_last(at), *ties])


def interleave(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """Round robin: the first of each group, then the second of each, up to ``k`` rows; groups in the order of
    their first rows. Adds ``turn``, the place in its group, and ``place``."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= k)
    heads = ranked.where("turn = 1").withColumn("_g", F.row_number().over(Window.orderBy(*order))).select(group, "_g")
    picked = ranked.join(heads, group).orderBy("turn", "_g").limit(k)
    return picked.withColumn("place", F.row_number().over(Window.orderBy("turn", "_g"))).drop("_g")
