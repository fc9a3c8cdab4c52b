"""Connected components of an edge table by alternating star contractions.

Every step is a grouped minimum (partial rows before the shuffle, so a hub of
any degree is one row per task) and a join; edges shrink towards stars around
the smallest node, in a number of steps that grows with the logarithm of the
longest path. Each half of a step is written to the shared folder: nested in one
plan the halves would multiply, and with them the broadcasts and scans that the
driver holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.shared import drop_scratch, scratch


def _either(first: tuple[str, str], second: tuple[str, str]) -> Column:
    """Two edges from one row: the table below is read and joined once."""
    return F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (first, second)]))


def _large_star(edges: DataFrame) -> DataFrame:
    # Here and in _small_star every edge has a < b.
    both = edges.select(_either(("a", "b"), ("b", "a")).alias("edge")).select("edge.a", "edge.b")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return edges.join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # b's smaller neighbours meet at the least one.
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(_either(("m", "a"), ("m", "b")).alias("edge"))
    return moved.select("edge.a", "edge.b").where("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either a least end or a leaf with one edge."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")),
                F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")),
            )
        ).alias("end")
    )
    seen = ends.groupBy("end.node").agg(F.sum("end.leaf").alias("edges"), F.min("end.leaf").alias("leaf"))
    return seen.where("edges > leaf").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b of type long):
    the smallest node reachable. Loops and repeated edges do no harm; nodes
    without edges do not appear."""
    now = scratch(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    # Stars around their least nodes are the end: a step leaves them as they are.
    while not _all_stars(now):
        large = scratch(_large_star(now), "large-stars")
        after = scratch(_small_star(large), "stars")
        drop_scratch(now)
        drop_scratch(large)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
