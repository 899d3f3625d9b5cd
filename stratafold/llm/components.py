"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.session import cut


def _linked_to_least(pairs: DataFrame, keep_lower: bool) -> DataFrame:
    """One star step: ``pairs`` (u, v) lists neighbours v of u; each kept neighbour, and u, move to the least of u and its neighbours.

    The large star keeps the neighbours above u, the small star those below. Sums by u first: no node gathers its neighbours.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if keep_lower:
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a, b) is either a root or has exactly one edge, to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of the undirected ``edges`` (a, b); written at every round.

    Without edges there are no rows. Rounds grow with the logarithm of the longest chain; they end when all edges form stars.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _linked_to_least(both, False)
        now = cut(_linked_to_least(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
