"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import store


def _to_least(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node ``a`` (those above it, or all) to the least of them and ``a``.

    The least is a plain aggregate, and the join back uses its partitioning. A node with very many
    neighbours sends pairs of two numbers to one task, which sorts them on disk if it must; nothing
    is gathered in memory. (Storing the least first would let Spark split that join, at twice as
    many small writes in every round.)
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = pairs.join(least, "a")
    if larger_only:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the edges; the component is its least node.

    Every round is written to the shared folder. Edges of a node to itself are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    now, mark = store(now, "edges"), None
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        large = store(_to_least(both, True).filter("a > b").distinct(), "large-star")
        now = store(_to_least(large, False).filter("a > b").distinct(), "small-star")
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_of == mark:
            break
        mark = print_of
    # Every node now has one edge, to the least of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
