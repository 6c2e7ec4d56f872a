"""Connected parts of a table of links, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.session import discard, scratch_path


def connected_parts(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, part) for every node of the links; a part is named after its smallest node.

    Each node points to a smaller node of its part or to itself. A round
    points every node with a smaller neighbour to the smallest one, moves the
    links to where their ends now point, and drops those inside one part; at
    last the pointers are followed to their roots, two steps at a time.
    Minima are combined before they are shuffled, so a node that most links
    meet is no larger a task than others. Every round is a stored table.
    """
    spark = links.sparkSession
    stored: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.mode("overwrite").parquet(path)
        stored.append(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    parts = keep(nodes.distinct().select("node", F.col("node").alias("part")), "parts")
    edges = keep(edges.filter("a <> b").distinct(), "links")
    while not edges.isEmpty():
        # Larger roots learn the smallest root that a link leads to.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.filter("b < a").groupBy(F.col("a").alias("part")).agg(F.min("b").alias("hook"))
        hooks = keep(best, "hooks")
        twice = hooks.join(hooks.select(F.col("part").alias("hook"), F.col("hook").alias("over")), "hook", "left")
        hooks = twice.select("part", F.coalesce("over", "hook").alias("hook"))
        parts = parts.join(hooks, "part", "left").select("node", F.coalesce("hook", "part").alias("part"))
        parts = keep(parts, "parts")
        roots = parts.filter(F.col("node") != F.col("part")).select("node", "part")
        moved = edges.join(roots.select(F.col("node").alias("a"), F.col("part").alias("ra")), "a", "left").join(
            roots.select(F.col("node").alias("b"), F.col("part").alias("rb")), "b", "left"
        )
        moved = moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = keep(moved.filter("a <> b").distinct(), "links")
        discard(spark, *stored[:-2])
        del stored[:-2]
    # A root may have been hooked after others were pointed to it.
    while True:
        up = parts.select(F.col("node").alias("part"), F.col("part").alias("root"))
        jumped = keep(parts.join(up, "part").select("node", F.col("root").alias("part")), "parts")
        changed = not jumped.join(parts, ["node", "part"], "left_anti").isEmpty()
        parts = jumped
        if not changed:
            return parts
