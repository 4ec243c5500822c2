"""Connected components of an edge table by alternating star steps (all work stays in shuffles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(a long, b long)``.

    ``component`` is the smallest node reachable.  The number of rounds grows with the logarithm of the longest
    path; each round is a map-side combined minimum per node and one join, and lineage is cut after it.  A node
    with very many neighbours is one small row on the minimum's side, so its edges can be split (skew join).
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = edges.count()
    while total:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour points to the least node of the star.
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: each node and its smaller neighbours point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct())
        # Stars with their least node in the middle: every node has one edge, and no middle has one.
        tied = edges.groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "x")
        loose = edges.join(tied, edges["b"] == tied["x"], "left_semi").limit(1).count() + tied.where("n > 1").limit(1).count()
        if not loose:
            break
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
