"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.llm.session import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the node's smallest neighbour. a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a and b, any order, repeats and loops allowed. Returns each linked node and its component.

    Columns node and component (its smallest node); nodes without links are not in it. Sums and joins only, so a node
    with many links is summed up before it is moved, and a hot one is split by the adaptive join. Each round is cut
    off from the one before it; the number of rounds grows as the logarithm of the longest chain.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = checkpointed(edges.distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        state = now
        stars = _small(_large(edges).distinct()).where("a < b").distinct()
        edges = checkpointed(stars)
