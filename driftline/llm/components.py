"""Connected components of an edge table by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) turn every component
into a star around its smallest node; each step is two hash aggregations and a
join, so no node's neighbours meet in one row, and nothing reaches the driver
but whether all is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: one row for each node that
    has an edge and isn't its component's smallest; root is the smallest.

    Self links and rows with a null end are ignored; repeated edges and either
    direction are fine; an empty table gives an empty one.
    """
    now = work.write(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = work.write(_small_star(_large_star(now)), "stars")
        work.drop(now)
        now = after
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
