"""Connected components of an edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014), written as joins. Each step is one
aggregate with partial minima and one join whose sides are both exchanged, so
adaptive execution can split the spokes of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), 2 * rows)
    spokes = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return settle(_ordered(spokes.select(F.col("v").alias("a"), F.col("m").alias("b"))), rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m")), rows)
    spokes = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return settle(_ordered(spokes.unionByName(least.select("a", F.col("m").alias("b")))), rows)


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end to its smaller one; loops go."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one root, which hangs on nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    sums = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.filter("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node reachable.

    ``edges`` has two columns a and b of one ordered type. Loops and repeats do
    no harm. An empty table gives an empty result.
    """
    current = settle(_ordered(edges))
    rows = current.count()
    while rows and not _are_stars(current):
        # A small star keeps at most one edge more per node than it is given.
        current = _small_star(_large_star(current, rows), 2 * rows)
        rows = current.count()
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
