"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every id has one edge down, or only edges that end at it."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("ends")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("ends")))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("ends").alias("ends")).filter("down > 1 or (down = 1 and ends = 1)").isEmpty()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id with an edge to another, except those that are their own component's smallest id.

    Only minima are gathered, never the neighbours of an id, so a hub costs no more than its edges. Each round is a
    checkpoint; the number of rounds grows with the logarithm of the longest chain, and the last is the one that leaves stars only. Edges with a null end are left out.
    """
    now = checkpointed(_down(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")))
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = checkpointed(_down(small))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
