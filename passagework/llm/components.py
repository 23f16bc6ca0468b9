"""Connected components of a link table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.plans.stage import stage


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links`` (longs ``a, b``).

    Self-links are ignored, repeated and reversed links count once, a null end drops the link. Every round is written to
    the shared folder, so a lost executor costs one round at most. A round is two aggregates with map-side minima and two
    joins on the node; a node with very many links is split by the adaptive skew join. The rounds grow with the logarithm
    of the longest path; reaching ``rounds`` raises instead of returning half-joined groups.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stage(links.where("a <> b").select(high, low).distinct(), "links")
    seen = _mark(edges)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        edges = stage(_small_star(_large_star(edges)), "links")
        mark = _mark(edges)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
