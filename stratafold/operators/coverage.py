"""Sampling quality tables: distributions, coverage and overlap between draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ordering import exact_quantiles, join_groups, largest_group

# Quantiles of a distribution row (fixed values).
SUMMARY_PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return join_groups(base, exact_quantiles(df, keys, value, SUMMARY_PROBS, rows=largest_group(df, keys)), list(keys))


def coverage_summary(df: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct(cell).alias("cells"))


def membership(df: DataFrame, member: str, key: str) -> DataFrame:
    """(sorted member list, number of keys): keys are folded before any pair is formed."""
    sets = df.select(member, key).distinct().groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("keys"))


def pairwise_jaccard(df: DataFrame, member: str, key: str) -> DataFrame:
    """Shared keys and Jaccard index for every pair of members, from folded member lists."""
    folded = membership(df, member, key)
    left = folded.select("members", "keys", F.explode("members").alias("a"))
    pairs = left.select("a", "keys", F.explode("members").alias("b")).where(F.col("a") < F.col("b"))
    inter = pairs.groupBy("a", "b").agg(F.sum("keys").alias("shared"))
    sizes = left.groupBy("a").agg(F.sum("keys").alias("n"))
    # One row per member: the pair frame is the member list with itself, a < b.
    names = sizes.agg(F.array_sort(F.collect_set("a")).alias("names"))
    frame = names.select(F.explode("names").alias("a"), "names").select("a", F.explode("names").alias("b")).where(F.col("a") < F.col("b"))
    joined = (
        frame.join(inter, ["a", "b"], "left")
        .join(sizes.select("a", F.col("n").alias("n_a")), "a")
        .join(sizes.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    )
    shared = F.coalesce(F.col("shared"), F.lit(0).cast("bigint"))
    return joined.select(
        "a", "b", "n_a", "n_b", shared.alias("shared"),
        (shared / (F.col("n_a") + F.col("n_b") - shared).cast("double")).alias("jaccard"),
    )


def overlap_with(df: DataFrame, original: DataFrame, member: str, key: str) -> DataFrame:
    """Per member: distinct keys, keys also in ``original`` and Jaccard against it."""
    mine = df.select(member, key).distinct()
    base = original.select(key).distinct()
    total = base.agg(F.count("*").alias("n_original"))
    flagged = mine.join(base.withColumn("_hit", F.lit(1)), key, "left")
    agg = flagged.groupBy(member).agg(F.count("*").alias("n"), F.count("_hit").alias("shared"))
    joined = agg.join(F.broadcast(total))  # one row
    return joined.select(
        member, "n", "n_original", "shared",
        (F.col("shared") / (F.col("n") + F.col("n_original") - F.col("shared")).cast("double")).alias("jaccard"),
    )


def ranking_gaps(summary: DataFrame, method: str, value: str) -> DataFrame:
    """Mean differences between all pairs of methods (one summary row per method)."""
    a = summary.select(F.col(method).alias("better"), F.col(value).alias("_a"))
    b = summary.select(F.col(method).alias("worse"), F.col(value).alias("_b"))
    return a.join(b, (F.col("_a") > F.col("_b"))).select("better", "worse", (F.col("_a") - F.col("_b")).alias("gap"))
