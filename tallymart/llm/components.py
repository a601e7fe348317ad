"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def least_neighbours(edges: DataFrame) -> DataFrame:
    """(a, low, n): the least smaller neighbour of each node that has one, and how many it has."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node in an edge (a, b); component: the least node reachable.

    Edges may come in either direction and repeatedly; loops and nulls are
    ignored. They are kept as (larger, smaller), so a large-star step moves
    every edge from its smaller end to that end's least neighbour, and a
    small-star step ties the smaller ends of a node to the least of them. It
    is done when every larger end has one edge and no smaller end has any. Hubs
    are safe: a step takes minima and joins on them, and gathers no
    neighbourhoods; each step is written, so that small ones join without a
    shuffle and skewed ones are split.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    least = least_neighbours(edges)
    for _ in range(most):
        of_low = least.select(F.col("a").alias("b"), F.col("low").alias("lower"))
        moved = edges.join(of_low, "b", "left").select("a", "b", "lower")
        if not least.where("n > 1").limit(1).count() and not moved.where("lower is not null").limit(1).count():
            roots = least.select(F.col("low").alias("node")).distinct()
            return least.select(F.col("a").alias("node"), F.col("low").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        large = cut(moved.select("a", F.coalesce("lower", "b").alias("b")))
        hubs = least_neighbours(large)
        small = large.join(hubs.select("a", "low"), "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        done, edges = (edges, least, large, hubs), cut(small.unionByName(hubs.select("a", F.col("low").alias("b"))).distinct())
        least = least_neighbours(edges)
        discard(*done)
    raise RuntimeError(f"components did not settle in {most} rounds")
