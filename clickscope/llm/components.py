"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Every step is a ``min`` aggregate (with map-side combine) and an equi-join on the node;
the edges of each round are stored in the shared folder, which cuts the lineage.  A hub
is one row of the aggregated side of a join, so AQE can split its partition.  No part of
the graph reaches the driver: it sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscope.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least node around it."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionAll(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; ``root`` is the least node reachable.

    Self-loops, repeated and reversed edges are allowed; edges with a null end are
    ignored; no edges give an empty table."""
    current = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(current)
    while seen[0]:
        current = materialize(_small_star(_large_star(current)), "edges")
        now = mark(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
