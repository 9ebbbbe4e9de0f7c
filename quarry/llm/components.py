"""Connected components by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v, least): every pair with the least of u and all partners of u.

    The minima are cut off before the join: a join that reads its own
    aggregate cannot be split, and the partners of one node may be most rows."""
    least = cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("least")))
    return pairs.join(least.withColumn("least", F.least("u", "least")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _stars(down)
    return (found.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(found.select("u", F.col("least").alias("v"))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; edges: (u, v) longs.

    The component is its smallest node.  Each round is checkpointed; the
    stars' minima are combined before the shuffle, so a node with very many
    partners costs no more than its edges."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    for _ in range(max_rounds):
        for star in (_large_star, _small_star):
            edges = cut_lineage(star(edges).where("u <> v").distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
