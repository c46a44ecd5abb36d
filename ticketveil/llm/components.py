"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(edges: DataFrame) -> DataFrame:
    """``(a, low)``: the least of a node and its neighbours. Stored, so that the join with it has a
    plain exchange on both sides and adaptive execution can split a hub's rows."""
    return stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of its neighbourhood."""
    both = _both(edges)
    return (
        both.filter("b > a").join(_lowest(both), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    linked = edges.join(_lowest(edges), "a")
    return (
        linked.select(F.col("b").alias("a"), F.col("low").alias("b"))
        .filter("a <> b")
        .unionAll(linked.select("a", F.col("low").alias("b")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges (a, b)``; the component is its least node.

    Alternates large and small stars until the edges form stars and stay the same, which takes a
    number of rounds in the order of the logarithm of the longest path. Loops and repeated edges
    change nothing; an empty table gives an empty one; edges with a null end are left out.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = stored(edges.distinct()), None
    while True:
        state = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = stored(_small_star(stored(_large_star(edges))))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots))
