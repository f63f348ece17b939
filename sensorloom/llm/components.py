"""Connected components of a graph given by edges, by alternating large and small stars.

Each round links every node's larger neighbours to its smallest one and then its smaller neighbours likewise; the edges end as stars
around the smallest node of each component. No round gathers the neighbours of a node: minima are sums with a map-side part, and the
joins can be split at hubs. Each round's edges are written to the shared folder, so a lost executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.session import keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots, from edges (a, b); root is the smallest node reachable."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = keep(ordered, "edges")
    before = _signature(current)
    while before[0]:
        grown = keep(_large_star(current).distinct(), "edges")
        current = keep(_small_star(grown).distinct(), "edges")
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
