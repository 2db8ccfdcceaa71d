"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.tables import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One round over ``a, b`` with ``a > b``; minima are pre-aggregated, so a node of any degree is fine."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(lowest.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` of every node with an edge: the smallest id that edges ``a, b`` reach.

    Loops and null ends are ignored and edges may repeat.  Each round is written to the shared folder;
    only its row count and a checksum reach the driver.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(current)
    while True:
        following = stage(_stars(current), "stars")
        found = _mark(following)
        if found == mark:
            break
        current, mark = following, found
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)
