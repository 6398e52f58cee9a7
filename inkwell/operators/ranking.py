"""Exact places of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.lineage import cut


def placed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``, from 0 by ``order`` in each group, and ``total``, its rows.

    Rows are dealt out by ranges of (key, order), so a large group lies in many pieces; a row's place is how many rows the pieces before have, and its place in
    its own. No task sorts a group. Rows alike in ``order`` have any order between them.
    """
    ranges = cut(df.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranges.groupBy(key, "_p").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = sizes.select(F.col(key).alias("_key"), "_p", before.alias("_before"), F.sum("_n").over(whole).alias("total"))
    inside: Column = F.row_number().over(Window.partitionBy("_p", key).orderBy(*order)) - 1
    met = ranges.withColumn("_inside", inside).alias("r").join(pieces.alias("s"), (F.col("r._p") == F.col("s._p")) & F.col(key).eqNullSafe(F.col("_key")))
    return met.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_before") + F.col("_inside")).alias("place"), "total")
