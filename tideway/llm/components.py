"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import scratch, stored


def _digest(edges: DataFrame) -> tuple:
    """Of the set of edges, whatever their order."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (v, component) of each vertex of an edge; the component is its smallest vertex.

    Each step replaces the edges of a vertex by edges to its smallest neighbour; the minimum is taken
    with map-side combine and joined back, so a vertex with many edges is not gathered in a task. The
    steps end when the edges form stars around the smallest vertices.
    """
    with scratch() as keep:
        now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before = None
        while (digest := _digest(now)) != before:
            before = digest
            both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
            now = stored(small.where("a <> b").distinct())
        return keep(now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()))
