"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import join_evenly, release, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    moved = join_evenly(both.where("b > a"), least, ["a"], "n")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = join_evenly(edges, least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, in any order, repeats and loops allowed) to (node, root): root is the
    least node of the component. Nodes without an edge to another node don't appear; neither do
    edges with a null end. Work per round is linear in the edges; rounds grow with the logarithm
    of the longest path.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # done when no root has a root, and no node two
        ends = now.groupBy("a").agg(F.count("*").alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if open_.isEmpty():
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        wide = stored(_large_star(now))
        release(now)
        now = stored(_small_star(wide))
        release(wide)
