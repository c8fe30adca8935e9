"""Distributed union-find: connected components by alternating large and small stars.

Every round is two aggregations with map-side combining, and two joins with their results. A vertex's edges meet its result
map-side where it has very many (or all of them, where there are few vertices), so no vertex brings its edges to one
task. Rounds are written to the shared folder and the previous one is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, pick_hot

MAX_ROUNDS = 60


def _large_star(edges: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Link every larger neighbour of a vertex to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "least", 2 * n)
    return pick_hot(both, least, "a", scratch).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Link a vertex and its smaller neighbours to the least of these. Edges run from larger to smaller."""
    least = scratch.save(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least", n)
    moved = pick_hot(edges, least, "a", scratch).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of the vertices of ``edges`` (columns a, b); component is the least id reachable.

    A vertex that is the least of its component has no row. Loops and repeated edges are allowed, and
    edges with a null end are left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(edges, "edges")
    for _ in range(MAX_ROUNDS):
        # No star has more edges than it began with.
        n = now.count()
        large = scratch.save(_large_star(now, scratch, n), "large", 2 * n)
        after = scratch.save(_small_star(large, scratch, n), "stars", 2 * n)
        scratch.drop(large)
        scratch.drop(now)
        now = after
        # Settled: every vertex points to one other, which points nowhere.
        ends = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if now.select("b").join(ends.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and ends.where("n > 1").isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
