"""Threshold metrics as one conditional aggregate per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Probabilities are kept this far from 0 and 1 in the log loss (fixed value).
LOG_LOSS_MARGIN = 1e-7


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(
        top.cast("double") / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom.cast("double"))
    )


def confusion(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit = F.col(score) >= F.lit(float(threshold))
    real = F.col(label) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~real & ~hit).alias("tn"),
        F.count_if(~real & hit).alias("fp"),
        F.count_if(real & ~hit).alias("fn"),
        F.count_if(real & hit).alias("tp"),
    )


def threshold_metrics(
    df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5
) -> DataFrame:
    p = F.col(score).cast("double")
    y = F.col(label).cast("double")
    hit = p >= F.lit(float(threshold))
    real = F.col(label) == 1
    safe = F.greatest(F.lit(LOG_LOSS_MARGIN), F.least(F.lit(1 - LOG_LOSS_MARGIN), p))
    cells = df.groupBy(*keys).agg(
        F.count_if(~real & ~hit).alias("tn"),
        F.count_if(~real & hit).alias("fp"),
        F.count_if(real & ~hit).alias("fn"),
        F.count_if(real & hit).alias("tp"),
        F.count("*").alias("n"),
        F.avg((y - p) * (y - p)).alias("_brier"),
        F.avg(-(y * F.log(safe) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - safe))).alias("_log_loss"),
    )
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    # Only classes that occur count towards balanced accuracy.
    present = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    spread = (
        F.sqrt((tp + fp).cast("double")) * F.sqrt((tp + fn).cast("double"))
        * F.sqrt((tn + fp).cast("double")) * F.sqrt((tn + fn).cast("double"))
    )
    mcc = ratio(tp.cast("double") * tn - fp.cast("double") * fn, spread)
    return cells.select(
        *keys, "n",
        ratio(tp + fn, n).alias("positive_ratio"),
        ratio(tp + tn, n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / present).alias("balanced_accuracy"),
        mcc.alias("mcc"),
        # Undefined for a run with one class only.
        F.when((tp + fn > 0) & (tn + fp > 0), F.col("_brier")).alias("brier"),
        F.when((tp + fn > 0) & (tn + fp > 0), F.col("_log_loss")).alias("log_loss"),
    )


def class_report(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages."""
    cells = confusion(df, keys, score, label, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def entry(name, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    both = cells.select(*keys, entry("0", tn, fn, fp).alias("a"), entry("1", tp, fp, fn).alias("b"))

    def average(name, wa, wb):
        total = F.greatest(wa + wb, F.lit(1)).cast("double")
        mean = lambda f: (F.col("a")[f] * wa + F.col("b")[f] * wb) / total
        return F.struct(
            F.lit(name).alias("class"), mean("precision").alias("precision"), mean("recall").alias("recall"),
            mean("f1").alias("f1"), (F.col("a.support") + F.col("b.support")).alias("support"),
        )

    rows = F.array(
        F.col("a"), F.col("b"),
        average("macro avg", F.lit(1), F.lit(1)),
        average("weighted avg", F.col("a.support"), F.col("b.support")),
    )
    return both.select(*keys, F.inline(rows))
