"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., 2014). Each step is a partially aggregated minimum and an equi join; a node
with very many neighbours is split by the skew-join rule of adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.where(F.col("b") > F.col("a")).join(least, "a")
        .select(F.col("b"), F.col("m").alias("a")).where(F.col("a") != F.col("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b"), F.col("m").alias("a"))
    own = least.select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.union(own).where(F.col("a") != F.col("b")).distinct()


def _settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Checkpoint, and number and hash of the edges to see when nothing changes any more.

    Both come from the one job that writes the checkpoint."""
    seen = Observation()
    mixed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    settled = cut_lineage(edges.observe(
        seen, F.count(F.lit(1)).alias("edges"), mixed.alias("mixed")))
    return settled, (seen.get["edges"], seen.get["mixed"])


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its least node."""
    start = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    current, state = _settle(start.where(F.col("a") != F.col("b")).distinct())
    while state[0] > 0:
        current, new_state = _settle(_small_star(_large_star(current)).select("a", "b"))
        if new_state == state:
            break
        state = new_state
    leaves = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.union(roots)
