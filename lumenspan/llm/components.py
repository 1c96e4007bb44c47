"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that an edge of ``edges`` touches.

    ``root`` is the smallest node reachable.  Rounds of large-star and
    small-star (Kiveris et al. 2014) run until the edges are stars; each round
    is written to the shared folder.  Both steps are a minimum per node and a
    join, so a hot node is combined before the shuffle and its rows are split
    by the skew join.  NULL ends are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now, before = staged(pairs.distinct(), "stars"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if before == state:
            break
        before = state
        now = staged(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).groupBy("node").agg(F.min("root").alias("root"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to its smallest neighbour."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    larger = e.select(F.col("v").alias("n"), F.col("u").alias("w"))
    return larger.join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node is linked to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
