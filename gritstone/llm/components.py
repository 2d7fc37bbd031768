"""Connected components of a graph given by an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import discard, join_hot, written


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang each node's larger (large star) or smaller (small star) neighbours on the least of its neighbourhood.

    total: about the number of edges; the centre of a big star is a hot key.
    """
    pairs = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b"), F.least("a", "b"))
    pairs = pairs.toDF("u", "v")
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))
    hung = join_hot(pairs, least, "u", "degree", total).where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.union(least.select("u", "m"))
    return hung.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (a > b, distinct), and whether each node with an edge hangs on one that hangs on nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    total, loose = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return total or 0, not loose


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge. Edges stay distributed.

    Each round is written to the shared folder; what the driver sees is a row count and a flag per round. The
    number of rounds grows with the logarithm of the longest chain, and is 0 where the edges are stars around the least
    nodes already. Null ends are ignored, loops too.
    """
    spark = edges.sparkSession
    ends = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now, path = written(edges.where(F.col(a) != F.col(b)).select(*ends).distinct(), "edges")
    total, done = _state(now)
    while not done:
        following, next_path = written(_star(_star(now, True, total), False, total), "edges")
        discard(spark, path)
        now, path = following, next_path
        total, done = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
