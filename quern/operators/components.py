"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; the component is its smallest node.

    Each round points the larger neighbours of every node at its smallest neighbour (large star) and then does the
    same among the smaller ones (small star); the number of rounds grows with the logarithm of the longest path. Only
    minima are aggregated, so a node with very many edges never becomes one row or one task's list. Every round is
    written to the checkpoint folder. Loops and edges with a null end play no part; repeated edges count once.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = edges.where(F.col(a) != F.col(b)).select(big, small).distinct()
    now = cut_lineage(now)
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if (print_now := _fingerprint(now)) == seen:
            break
        seen = print_now
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())
