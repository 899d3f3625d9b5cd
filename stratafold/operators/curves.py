"""Curves on a fixed grid, mean bands and empirical distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators.ordering import prefix_totals, small_side


def interpolate_on_grid(curve: DataFrame, keys: Sequence[str], x: str, y: str, points: int) -> DataFrame:
    """Piecewise-linear value at ``points`` equal steps of [0, 1], clamped at the ends.

    Repeated x keep their largest y. Each curve point is folded into the grid
    cell it falls in, so only ``points`` rows per run are ever ordered.
    """
    keys = list(keys)
    steps = F.lit(float(points - 1))
    near = F.greatest(F.lit(0), F.ceil(F.col(x) * steps - F.lit(0.5))).cast("bigint")
    cell = F.when(near / steps < F.col(x), near + 1).otherwise(near)
    peaks = curve.groupBy(*keys, x).agg(F.max(y).alias("_y"))
    cells = (
        peaks.withColumn("step", cell)
        .groupBy(*keys, "step")
        .agg(
            F.max(F.struct(F.col(x).alias("x"), F.col("_y").alias("y"))).alias("_last"),
            F.min(F.struct(F.col(x).alias("x"), F.col("_y").alias("y"))).alias("_first"),
        )
    )
    # Points beyond 1 share one extra cell, so a run has at most points + 1 rows.
    cells = cells.withColumn("step", F.least(F.col("step"), F.lit(points).cast("bigint")))
    cells = cells.groupBy(*keys, "step").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    grid = cells.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points).cast("bigint"))).alias("step"))
    match = F.col("g.step") == F.col("c.step")
    for key in keys:
        match = match & F.col(f"g.{key}").eqNullSafe(F.col(f"c.{key}"))
    full = grid.alias("g").join(cells.alias("c"), match, "left").select(
        *[F.col(f"g.{k}") for k in keys], "g.step", "c._last", "c._first"
    )
    frame = Window.partitionBy(*keys).orderBy("step")
    low = F.last("_last", ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_first", ignorenulls=True).over(frame.rowsBetween(1, Window.unboundedFollowing))
    at = F.col("step") / steps
    a, b = F.col("_low"), F.col("_high")
    value = (
        F.when(a.isNull(), b["y"])
        .when(b.isNull() | (a["x"] == at), a["y"])
        .otherwise((b["y"] - a["y"]) / (b["x"] - a["x"]) * (at - a["x"]) + a["y"])
    )
    return (
        full.select(*keys, "step", low.alias("_low"), high.alias("_high"))
        .where(F.col("step") < points)
        .select(*keys, "step", at.alias("grid"), value.alias("value"))
    )


def mean_band(gridded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample spread over runs at each grid step, band cut to [0, 1]."""
    agg = gridded.groupBy(*keys, "step", "grid").agg(
        F.count("value").alias("runs"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
    )
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") - F.col("sd")))
    high = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") + F.col("sd")))
    return agg.select("*", low.alias("low"), high.alias("high"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str, row_id: str, rows: int | None = None) -> DataFrame:
    """i / n for every observation; tied values keep separate steps."""
    data = df.where(F.col(value).isNotNull()).select(*keys, row_id, value)
    placed = prefix_totals(
        data, keys, [F.col(value).asc(), F.col(row_id).asc()],
        totals={"_n": F.lit(1).cast("bigint")}, position="_at", rows=rows,
    )
    return placed.select(*keys, row_id, value, (F.col("_at") / F.col("_n").cast("double")).alias("ecdf"))


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return big.join(small_side(small), list(on), how)
