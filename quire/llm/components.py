"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written


def _least(rows: DataFrame) -> DataFrame:
    """Each u's least neighbour or itself."""
    return rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = _least(down)
    linked = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b")


def _is_done(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("b").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.low").alias("low"), F.max("e.top").alias("top"))
    return not seen.filter("low + top > 1").take(1)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its least node.

    Every step writes its links, at most as many as before, to the shared folder, and it
    ends when each node but the least of a component hangs on that one alone.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while not _is_done(edges):
        edges = written(_small_star(_large_star(edges)).distinct(), "edges")
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("e")).select("e.*").distinct()
