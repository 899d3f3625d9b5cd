"""Paired tests, resampling intervals and multiplicity adjustment per comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.keys import uniform
from stratafold.operators.ordering import exact_quantiles, join_groups, largest_group, prefix_totals
from stratafold.operators.ranking import average_ranks
from stratafold.session import cut

# Differences this close to zero count as no difference (fixed value).
ZERO_ATOL = 1e-8
# Largest sample whose sign distribution the automatic mode takes (fixed value).
EXACT_LIMIT = 50


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|N(0,1)| >= |z|)."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper chi-square tail for whole degrees of freedom, by the recurrence in steps of two."""
    def one(v, k):
        if v is None or k is None or math.isnan(v):
            return None
        half, k = v / 2.0, int(k)
        a, tail = (1.0, math.exp(-half)) if k % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
        while a < k / 2.0:
            tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1.0)) if half > 0 else 0.0
            a += 1.0
        return tail

    return pd.Series([one(v, k) for v, k in zip(x, df)], dtype="float64")


def holm(df: DataFrame, keys: Sequence[str], p: str, row_id: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p per family; missing p stay missing and do not count."""
    df = cut(df)  # one row per test, read several times below
    present = df.where(F.col(p).isNotNull())
    rows = largest_group(present, keys)
    placed = prefix_totals(
        present, keys, [F.col(p).asc(), F.col(row_id).asc()], totals={"_m": F.lit(1).cast("bigint")}, position="_r", rows=rows
    ).withColumn("_raw", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    adjusted = prefix_totals(
        placed, keys, [F.col(p).asc(), F.col(row_id).asc()], maxima={out: F.col("_raw")}, rows=rows
    ).drop("_m", "_r", "_raw")
    missing = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return adjusted.unionByName(missing)


def paired_differences(
    df: DataFrame, block: str, method: str, metric: str, target: str, extra: Sequence[str] = ()
) -> DataFrame:
    """target minus every other method on the blocks where both are present."""
    left = df.where(F.col(method) == target).select(*extra, block, F.col(metric).alias("_a"))
    right = df.where(F.col(method) != target).select(
        *extra, block, F.col(method).alias("baseline"), F.col(metric).alias("_b")
    )
    pair = left.join(right, [*extra, block])
    return pair.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        *extra, "baseline", block, (F.col("_a") - F.col("_b")).alias("diff")
    )


def difference_summary(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = diffs.groupBy(*keys).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"))
    quart = exact_quantiles(diffs, keys, "diff", {"q1_diff": 0.25, "median_diff": 0.5, "q3_diff": 0.75})
    return join_groups(base, quart, list(keys))


def signed_ranks(diffs: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """(keys, size, ties, plus, minus, rank, all_n) per distinct nonzero |diff|, average ranks."""
    keys = list(keys)
    if rows is None:
        rows = largest_group(diffs, keys)
    folded = diffs.where(F.col("diff") != 0).groupBy(*keys, F.abs("diff").alias("size")).agg(
        F.count("*").alias("ties"), F.count_if(F.col("diff") > 0).alias("plus"), F.count_if(F.col("diff") < 0).alias("minus"))
    placed = prefix_totals(
        folded, keys, [F.col("size").asc()], sums={"_upto": F.col("ties")}, totals={"all_n": F.col("ties")}, rows=rows)
    return placed.withColumn("rank", F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)).drop("_upto")


def rank_biserial(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(R+ - R-) / (R+ + R-); 0 when every difference is zero."""
    keys = list(keys)
    sums = signed_ranks(diffs, keys).groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("plus")).alias("_up"), F.sum(F.col("rank") * F.col("minus")).alias("_down")
    )
    groups = diffs.select(*keys).distinct()
    joined = groups.join(sums, keys, "left")
    effect = (F.col("_up") - F.col("_down")) / (F.col("_up") + F.col("_down"))
    return joined.select(*keys, F.coalesce(effect, F.lit(0.0)).alias("rank_biserial"))


@F.pandas_udf(T.DoubleType())
def sign_tail(doubled: pd.Series, low: pd.Series) -> pd.Series:
    """Two-sided share of sign patterns whose doubled rank sum is at most ``low``.

    Shares are halved at every rank instead of counting patterns, so nothing overflows at any size.
    """
    def one(ranks, most):
        if ranks is None or most is None or math.isnan(most):
            return None
        share = np.zeros(int(np.sum(ranks)) + 1)
        share[0] = 1.0
        for r in ranks:
            half = share / 2
            half[r:] += share[:len(share) - r] / 2
            share = half
        return min(1.0, 2.0 * float(share[:int(most) + 1].sum()))

    return pd.Series([one(r, m) for r, m in zip(doubled, low)], dtype="float64")


def wilcoxon(diffs: DataFrame, keys: Sequence[str], mode: str = "auto") -> DataFrame:
    """Two-sided signed-rank test, zeros dropped; all-zero comparisons give (0, 1).

    ``exact`` takes the distribution over all signs at any size (a comparison's
    ranks meet in one row); ``auto`` does so for up to 50 differences without
    zeros and ties and else uses the tie-corrected normal approximation.
    """
    keys = list(keys)
    n = F.col("_n")
    gathered = F.lit(True) if mode == "exact" else F.col("all_n") <= EXACT_LIMIT
    doubled = F.array_repeat((F.col("rank") * 2).cast("int"), F.col("ties").cast("int"))
    sums = signed_ranks(diffs, keys).groupBy(*keys).agg(
        F.sum("ties").alias("_n"),
        F.sum(F.col("rank") * F.col("plus")).alias("_up"),
        F.sum(F.col("rank") * F.col("minus")).alias("_down"),
        F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("_tie"),
        F.max("ties").alias("_most"),
        F.flatten(F.collect_list(F.when(gathered, doubled))).alias("_ranks"),
    )
    general = diffs.groupBy(*keys).agg(
        F.count("diff").alias("n"),
        F.count_if(F.col("diff") == 0).alias("_zeros"),
        F.coalesce(F.bool_and(F.abs("diff") <= ZERO_ATOL), F.lit(False)).alias("_flat"),
    )
    exact = n.isNotNull()
    if mode == "auto":
        exact = (n <= EXACT_LIMIT) & (F.col("_most") == 1) & (F.col("_zeros") == 0)
    full = general.join(sums, keys, "left").withColumn("_exact", F.coalesce(exact, F.lit(False)))
    low = F.least("_up", "_down")
    mean = n * (n + 1) / 4.0
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0)
    p = (
        F.when(F.col("_flat") | n.isNull(), F.lit(1.0))
        .when(F.col("_exact"), F.col("_tail"))
        .otherwise(F.col("_approx"))
    )
    statistic = F.when(F.col("_flat") | n.isNull(), F.lit(0.0)).otherwise(low)
    staged = full.withColumn("_tail", sign_tail(F.when(F.col("_exact"), F.col("_ranks")), F.when(F.col("_exact"), low * 2))).withColumn(
        "_approx", normal_two_sided((low - mean) / F.when(spread > 0, spread))
    )
    return staged.select(*keys, "n", statistic.alias("statistic"), p.alias("p_raw"))


def friedman(df: DataFrame, block: str, method: str, metric: str, extra: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected chi-square over the blocks on which every method is present."""
    extra = list(extra)
    present = df.where(F.col(metric).isNotNull())
    k_all = present.groupBy(*extra).agg(F.countDistinct(method).alias("_k")) if extra else present.agg(F.countDistinct(method).alias("_k"))
    per_block = present.groupBy(*extra, block).agg(F.count("*").alias("_have"))
    complete = (per_block.join(k_all, extra) if extra else per_block.join(F.broadcast(k_all))).where(
        F.col("_have") == F.col("_k")
    ).select(*extra, block, "_k")
    matched = present.join(complete, [*extra, block])
    ranks = average_ranks(matched, [*extra, block], metric)
    rows = matched.join(ranks, [*extra, block, metric])
    sums = rows.groupBy(*extra, method).agg(F.sum("rank").alias("_r"), F.count("*").alias("_n"), F.max("_k").alias("_k"))
    ties = ranks.groupBy(*extra).agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("_ties"))
    agg = [F.sum(F.col("_r") * F.col("_r")).alias("_ss"), F.max("_n").alias("_n"), F.max("_k").alias("_k")]
    total = sums.groupBy(*extra).agg(*agg)
    both = total.join(ties, extra) if extra else total.join(F.broadcast(ties))
    k, n = F.col("_k").cast("double"), F.col("_n").cast("double")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1)
    correction = 1.0 - F.col("_ties") / (n * k * (k * k - 1))
    usable = (F.col("_k") >= 3) & (F.col("_n") >= 2) & (correction > 0)
    stat = F.when(usable, raw / F.when(correction > 0, correction))
    out = both.select(*extra, F.col("_k").alias("n_models"), F.col("_n").alias("n_blocks"), stat.alias("statistic"))
    return out.withColumn("p_value", chi2_tail(F.col("statistic"), (F.col("n_models") - 1).cast("double")))


def jarque_bera(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Moment-based normality check, NULL under three values or without spread."""
    agg = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.var_pop(value).alias("_v"),
        F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"),
    )
    stat = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    usable = (F.col("n") >= 3) & (F.col("_v") > 0)
    out = agg.select(*keys, "n", F.when(usable, stat).alias("statistic"))
    return out.select("*", F.exp(-F.col("statistic") / 2.0).alias("p_value"))


# Cumulative shares of a Poisson(1) count from 0 to 17; a uniform's count is the number of them at or below it.
POISSON_STEPS = [sum(math.exp(-1.0) / math.factorial(k) for k in range(top + 1)) for top in range(18)]


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform, by inverting the distribution."""
    weight = F.lit(0)
    for count, step in enumerate(POISSON_STEPS, start=1):
        weight = F.when(u >= step, count).otherwise(weight)
    return weight


def bootstrap_mean_ci(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, *, draws: int = 10_000, seed: int = 2026,
) -> DataFrame:
    """Percentile interval (2.5 %, 97.5 %) of the mean over resamples with replacement.

    At every size each row gets a hashed Poisson(1) count per replicate, so
    sums combine map-side and no draw is shuffled or needs shared state; a
    replicate without any row is left out. Groups without values have NULLs.
    """
    keys = list(keys)
    data = df.select(*keys, row_id, F.col(value).alias("_x"))
    base = data.groupBy(*keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"))
    spread = data.where(F.col("_x").isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_rep"))
    w = poisson_weight(uniform(seed, "poisson", *[F.col(k) for k in keys], F.col("_rep"), F.col(row_id)))
    sums = spread.withColumn("_w", w).groupBy(*keys, "_rep").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_mean"))
    return join_groups(base, exact_quantiles(sums, keys, "_mean", {"ci_low": 0.025, "ci_high": 0.975}, rows=draws), keys)


def bootstrap_means_ci(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], row_id: str, *, draws: int = 10_000, seed: int = 2026,
) -> DataFrame:
    """(keys, metric, ci_low, ci_high): percentile intervals of the means of many columns over the same resamples.

    A row's Poisson count of a replicate serves all its columns. NULL values take no part in their column's mean.
    """
    keys = list(keys)
    spread = df.select(*keys, row_id, *values, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_rep"))
    spread = spread.withColumn("_w", poisson_weight(uniform(seed, "poisson", *[F.col(k) for k in keys], F.col("_rep"), F.col(row_id))))
    means = spread.groupBy(*keys, "_rep").agg(*[
        (F.sum(F.col("_w") * F.col(v)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))), F.lit(0))).alias(v) for v in values])
    tall = means.unpivot([*keys, "_rep"], list(values), "metric", "_mean")
    return exact_quantiles(tall, [*keys, "metric"], "_mean", {"ci_low": 0.025, "ci_high": 0.975}, rows=draws)


def metric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample sd (0 for one run), median, quartiles and extremes per group."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quart = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows=largest_group(df, keys))
    return join_groups(base, quart, list(keys))
