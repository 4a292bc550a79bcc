"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a group minimum and a join, so a node with a third of all links is combined before the
shuffle and split by the adaptive join. Every step is written to the shared folder, which cuts the lineage
and lets a later step survive a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked to the least of them; here a > b in every row."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one lower neighbour at most and no lower neighbour has one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionAll(edges.select(F.col("b"), F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not seen.where("ups > 1 OR (ups = 1 AND least = 0)").head(1)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; the component is its least node. Links with a null end are no links."""
    big, small = F.greatest(a, b), F.least(a, b)
    edges = materialize(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.alias("a"), small.alias("b")).distinct(), "links")
    while not _is_forest_of_stars(edges):
        # Written between the two steps: each reads its input twice.
        edges = materialize(_small_star(materialize(_large_star(edges), "links")), "links")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
