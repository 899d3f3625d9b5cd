"""Ranking metrics and curves for many runs in one grouped job.

Rows are first folded to one row per (run, distinct score) with map-side
combine, so tied scores never reach a sort and AP/ROC need no row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ordering import largest_group, prefix_totals


def score_curve(
    df: DataFrame, keys: Sequence[str], score: str, label: str, rows: int | None = None
) -> DataFrame:
    """(keys, score, n, pos, cum_n, cum_pos, all_n, all_pos), best score first."""
    if rows is None:
        rows = largest_group(df, keys)
    folded = df.groupBy(*keys, score).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return prefix_totals(
        folded, keys, [F.col(score).desc()],
        sums={"cum_n": F.col("n"), "cum_pos": F.col("pos")},
        totals={"all_n": F.col("n"), "all_pos": F.col("pos")},
        rows=rows,
    )


def _two_classes() -> Column:
    return (F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n"))


def ranking_metrics(
    df: DataFrame, keys: Sequence[str], score: str, label: str, rows: int | None = None
) -> DataFrame:
    """n, positives, roc_auc and step-wise average precision; NULL for one-class runs."""
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    curve = score_curve(df, keys, score, label, rows)
    won = (n - pos) * (F.col("cum_pos") - pos / F.lit(2.0))
    sums = curve.groupBy(*keys).agg(
        F.max("all_n").alias("all_n"),
        F.max("all_pos").alias("all_pos"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("_gain"),
        F.sum(won).alias("_won"),
    )
    p, q = F.col("all_pos").cast("double"), (F.col("all_n") - F.col("all_pos")).cast("double")
    return sums.select(
        *keys,
        F.col("all_n").alias("n"),
        F.col("all_pos").alias("positives"),
        F.when(_two_classes(), F.col("_won") / (p * q)).alias("roc_auc"),
        F.when(_two_classes(), F.col("_gain") / p).alias("average_precision"),
    )


def roc_points(df, keys, score, label, rows=None) -> DataFrame:
    """(fpr, tpr) at every distinct score of runs that hold both classes."""
    curve = score_curve(df, keys, score, label, rows).where(_two_classes())
    negatives = (F.col("all_n") - F.col("all_pos")).cast("double")
    return curve.select(
        *keys,
        F.col(score).alias("threshold"),
        ((F.col("cum_n") - F.col("cum_pos")) / negatives).alias("fpr"),
        (F.col("cum_pos") / F.col("all_pos").cast("double")).alias("tpr"),
    )


def pr_points(df, keys, score, label, rows=None) -> DataFrame:
    """(recall, precision) at every distinct score of runs that hold both classes."""
    curve = score_curve(df, keys, score, label, rows).where(_two_classes())
    return curve.select(
        *keys,
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("all_pos").cast("double")).alias("recall"),
        (F.col("cum_pos") / F.col("cum_n").cast("double")).alias("precision"),
    )


def top_fraction(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    row_id: str,
    fractions: Sequence[float] = (0.01, 0.05, 0.10),
    rows: int | None = None,
) -> DataFrame:
    """Capture and precision among the best k = max(1, ceil(n * f)) rows, ties by id.

    Only the rows tied at the cut-off score are ever ordered by id.
    """
    keys = list(keys)
    if rows is None:
        rows = largest_group(df, keys)
    curve = score_curve(df, keys, score, label, rows)
    asked = curve.select("*", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    asked = asked.withColumn(
        "k", F.greatest(F.lit(1), F.ceil(F.col("all_n") * F.col("fraction"))).cast("bigint")
    )
    edge = asked.where((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k"))).select(
        *keys, F.col(score).alias("_edge"), "fraction", "k", "n", "pos", "all_n", "all_pos",
        (F.col("k") - (F.col("cum_n") - F.col("n"))).alias("_need"),
        (F.col("cum_pos") - F.col("pos")).alias("_above"),
    )
    # A cut that takes a whole tie needs no row order.
    whole = edge.where(F.col("_need") == F.col("n")).select(
        *keys, "fraction", "k", "all_pos", (F.col("_above") + F.col("pos")).alias("captured")
    )
    partial = edge.where(F.col("_need") < F.col("n")).alias("e")
    tie_match = F.col("e._edge") == F.col(f"d.{score}")
    for key in keys:
        tie_match = tie_match & F.col(f"e.{key}").eqNullSafe(F.col(f"d.{key}"))
    tied = df.select(*keys, score, label, row_id).alias("d").join(partial, tie_match).select(
        *[F.col(f"e.{k}") for k in keys], "e.fraction", "e.k", "e.all_pos", "e._need", "e._above",
        F.col(f"d.{label}").cast("bigint").alias("_label"), F.col(f"d.{row_id}").alias("_id"),
    )
    placed = prefix_totals(tied, [*keys, "fraction"], [F.col("_id").asc()], position="_at", rows=rows)
    split = (
        placed.where(F.col("_at") <= F.col("_need"))
        .groupBy(*keys, "fraction", "k", "all_pos", "_above")
        .agg(F.sum("_label").alias("_in"))
        .select(*keys, "fraction", "k", "all_pos", (F.col("_above") + F.col("_in")).alias("captured"))
    )
    return whole.unionByName(split).select(
        *keys, "fraction", "k", "captured",
        (F.col("captured") / F.greatest(F.lit(1), F.col("all_pos")).cast("double")).alias("capture"),
        (F.col("captured") / F.col("k").cast("double")).alias("precision"),
    )


def gain_curve(df, keys, score, label, row_id, rows=None) -> DataFrame:
    """Share of rows against share of positives, one row per observation plus the origin."""
    placed = prefix_totals(
        df.select(*keys, score, F.col(label).cast("bigint").alias("_label"), row_id),
        keys, [F.col(score).desc(), F.col(row_id).asc()],
        sums={"_hits": F.col("_label")},
        totals={"_n": F.lit(1).cast("bigint"), "_all": F.col("_label")},
        position="_at", rows=rows,
    )
    found = F.greatest(F.col("_all"), F.lit(1)).cast("double")
    points = placed.select(
        *keys, F.col("_at").alias("position"),
        (F.col("_at") / F.col("_n").cast("double")).alias("share"),
        (F.col("_hits") / found).alias("gain"),
    )
    start = df.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("position"), F.lit(0.0).alias("share"), F.lit(0.0).alias("gain")
    )
    return start.unionByName(points)


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, *, descending: bool = False, rows: int | None = None
) -> DataFrame:
    """(keys, value, ties, rank, all_n): average rank of every distinct value."""
    if rows is None:
        rows = largest_group(df, keys)
    folded = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    placed = prefix_totals(
        folded, keys, [order], sums={"_upto": F.col("ties")}, totals={"all_n": F.col("ties")}, rows=rows
    )
    middle = F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)
    return placed.select(*keys, value, "ties", middle.alias("rank"), "all_n")


def rank_normalize(
    df: DataFrame, keys: Sequence[str], score: str, out: str, rows: int | None = None
) -> DataFrame:
    """Add ``out`` in [0, 1]: 1 for the best score, ties share their mean rank, 1 for a lone row."""
    keys = list(keys)
    ranks = average_ranks(df, keys, score, descending=True, rows=rows)
    scaled = F.when(F.col("all_n") == 1, F.lit(1.0)).otherwise(
        (F.col("all_n") - F.col("rank")) / F.greatest(F.col("all_n") - 1, F.lit(1)).cast("double")
    )
    table = ranks.select(*keys, score, scaled.alias(out)).alias("r")
    match = F.col("d._checked") == F.col(f"r.{score}")
    for key in keys:
        match = match & F.col(f"d.{key}").eqNullSafe(F.col(f"r.{key}"))
    missing = F.raise_error(F.lit("missing score")).cast("double")
    data = df.withColumn("_checked", F.when(F.col(score).isNull() | F.isnan(score), missing).otherwise(F.col(score)))
    return data.alias("d").join(table, match).select(*[F.col(f"d.{c}") for c in df.columns], F.col(f"r.{out}"))
