"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, new_path, written


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end."""
    return (
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the least node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ties = edges.join(least, "u")
    return ties.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of any orderable type to (node, root): root is the least node that can be reached.

    Nodes without an edge are absent. Groups are combined before each shuffle, edges stay as many as they were at
    most, and each round is written to the shared folder, in place of the round before.
    """
    path = new_path(edges.sparkSession, "edges")
    now = written(_pointed(edges), path)
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, last = state, path
        path = new_path(edges.sparkSession, "edges")
        now = written(_pointed(_small_star(_pointed(_large_star(now)))), path)
        discard(last)
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
