"""Connected components of a graph whose edges are rows, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: longs a and b. Returns node and component, the least node that it is linked with, for nodes that have edges.

    Each round links the neighbours of a node to the least of them: large-star those above the node, small-star those
    below. Rounds grow with the logarithm of the number of nodes in a component; a node is a row per edge, so a hub
    costs its edges once per round and never a product. Edges may repeat, be given either way round, or be loops.
    Each round's edges are written to the shared folder, and the last round's deleted; the rounds end when the edges stay.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        least = _both_ways(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _both_ways(edges).join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = written(small, "edges")
        total = new.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        drop_written(edges)
        edges = new
        if sign == (total["n"], total["h"]):
            break
        sign = (total["n"], total["h"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
