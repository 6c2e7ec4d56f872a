"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.session import Scratch


def components(links: DataFrame, scratch: Scratch, label: str = "stars") -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternating large and small stars: each round links every neighbour of a
    node to the smallest one it knows, until each component is one star.
    Minima are aggregated map-side and joined back, so a node that a third
    of all links meet needs no list of its neighbours anywhere. Every round
    is stored in the shared folder, and the driver lets go of its plans.
    """
    links = links.filter(F.col("a") != F.col("b"))
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0"
    )
    i = 0
    while not _are_stars(edges):
        i += 1
        edges = scratch.keep(_small_star(_large_star(edges)), f"{label}-{i}")
        scratch.drop(f"{label}-{i - 1}")
        scratch.release()
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most and no centre has a smaller one."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    centres = edges.select(F.col("v").alias("u")).distinct()
    return edges.join(centres, "u", "left_semi").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
