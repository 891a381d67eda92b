"""Connected components of edge tables by alternating star contractions, safe for hubs and lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lookup_hot, staged


def _nearest(edges: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """``edges`` with ``m``, looked up in ``target`` (``on``, ``m``, ``w``: number of edges)."""
    total = target.agg(F.sum("w")).first()[0] or 0
    return lookup_hot(edges, target, on, "w", total)


def _contract(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then every node and its smaller ones, move to the least neighbour."""
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = staged(both.groupBy("x").agg(F.min("y").alias("y"), F.count("*").alias("w")).select(F.col("x").alias("v"), F.least("x", "y").alias("m"), "w"), "large")
    edges = staged(_nearest(edges, least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct(), "edges")
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")), "small")
    met = _nearest(edges, least, "u")
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return staged(moved.unionByName(met.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: the least of its component, as edges lead downwards."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, the least node of its component, for every node that is not the least of its own.

    ``edges`` (``u`` > ``v``, longs) may repeat. Only whether a round settled them reaches the driver.
    """
    edges = staged(edges.select("u", "v").distinct(), "edges")
    while not _settled(edges):
        edges = _contract(edges)
    return edges
