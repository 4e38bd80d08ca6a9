"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.staging import Staging


def _large_star(edges: DataFrame, staging: Staging) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour.

    The smallest neighbours are written before they are joined: a node with very many
    links is then one skewed part of a plain shuffle, which can be split."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staging.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
    larger = both.where("b > a")
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.union(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame, staging: Staging, most: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its
    smallest node.

    Each round runs a large and a small star step as joins and aggregations and writes
    the edges to the shared folder; only a count and a checksum come to the driver. The
    number of rounds grows with the logarithm of the node count, also for long chains.
    Nodes without a link, loops and empty tables give no rows.
    """
    edges = staging.keep(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    for _ in range(most):
        scratch = Staging(staging.spark)
        star = scratch.keep(_large_star(edges, scratch).where("a <> b").distinct(), "star")
        edges = staging.swap(edges, _small_star(star).where("a <> b").distinct(), "links")
        scratch.only()
        seen = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
    return staging.swap(edges, found, "components")
