"""Connected components by minimum propagation with pointer jumping and contraction.

Each round every vertex joins the tree of its smallest neighbour, the edges are rewritten to tree roots, and loops and repeats go: the vertices at
least halve, so the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.cluster import cut, scoped


def links(edges: DataFrame) -> DataFrame:
    """Both directions of (a, b)."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def rewrite(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between the labels of their ends, without loops and repeats."""
    first = labels.select(F.col("v").alias("a"), F.col("label").alias("la"))
    second = labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    to = edges.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    return to.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@scoped
def propagate(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex that has an edge: the smallest vertex of its component. Vertices are of any ordered type."""
    labels = None
    while labels is None or not edges.isEmpty():
        least = links(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("up"))
        above = least.select(F.col("v").alias("up"), F.col("up").alias("top"))
        root = cut(least.join(above, "up").select("v", F.col("top").alias("label")))
        if labels is None:
            labels = root
        else:
            moved = root.select(F.col("v").alias("label"), F.col("label").alias("now"))
            labels = cut(labels.join(moved, "label", "left").select("v", F.coalesce("now", "label").alias("label")))
        edges = cut(rewrite(edges, root))
    return labels
