"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 100


def _minima(edges: DataFrame, both: bool) -> DataFrame:
    """Of each node the smallest neighbour; both: over all neighbours, else over smaller ones alone."""
    if both:
        arcs = edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("a")).select("a.*")
    else:
        arcs = edges
    return arcs, arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): the smallest node reachable, for every node that an edge names.

    Each round is two joins on the node with its aggregated minimum; no neighbour list is gathered, so a
    star of any size stays distributed. The number of rounds grows with the logarithm of a component's
    diameter. Rows with a null end or equal ends are left out. Each round ends in a table in the shared folder.
    An empty edge list gives an empty result.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, before = stored(now, "edges"), None
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of u is tied to u's smallest neighbour.
        arcs, minima = _minima(now, True)
        large = arcs.join(minima, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "large")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        arcs, minima = _minima(large, False)
        small = arcs.join(minima, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        now = stored(small, "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
