"""Regular point grids, positive candidates and their subsample."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.keys import order_key
from stratafold.operators import polygons
from stratafold.operators.ordering import prefix_totals


def point_grid(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, spacing: float) -> DataFrame:
    """Half-open grid anchored at the minimum bounds, x outer and y inner.

    One distributed range holds the whole grid; indices are arithmetic on it.
    """
    if not math.isfinite(spacing) or spacing <= 0:
        raise ValueError("the spacing must be finite and positive")
    nx, ny = math.ceil((max_x - min_x) / spacing), math.ceil((max_y - min_y) / spacing)
    if nx < 1 or ny < 1:
        raise ValueError("the bounds are smaller than the spacing")
    grid = spark.range(nx * ny).withColumnRenamed("id", "grid_ord")
    ix, iy = F.floor(F.col("grid_ord") / F.lit(ny)).cast("bigint"), F.col("grid_ord") % F.lit(ny)
    return grid.select(
        "grid_ord", ix.alias("x_idx"), iy.alias("y_idx"),
        (F.lit(float(min_x)) + ix * F.lit(float(spacing))).alias("x"), (F.lit(float(min_y)) + iy * F.lit(float(spacing))).alias("y"),
    )


def number_rows(df: DataFrame, order: str, pattern: str, out: str) -> DataFrame:
    """Zero-based text ids in the given order."""
    placed = prefix_totals(df, [], [F.col(order).asc()], position="_at")
    return placed.withColumn(out, F.format_string(pattern, F.col("_at") - 1)).drop("_at")


def positive_candidates(grid: DataFrame, known: DataFrame, study: DataFrame | None = None) -> DataFrame:
    """Grid points strictly inside the study area and the known polygons, numbered in grid order."""
    kept = grid if study is None else polygons.within(grid, study, "grid_ord")
    kept = polygons.within(kept, known, "grid_ord")
    return number_rows(kept, "grid_ord", "C%08d", "cand_id").withColumn("Class", F.lit(1).cast("smallint"))


def hash_draw(df: DataFrame, row_id: str, count: int, seed: int, purpose: str) -> DataFrame:
    """Exactly ``count`` rows without replacement, the first in hash order; adds ``draw_pos``."""
    keyed = df.withColumn("_key", order_key(seed, purpose, F.col(row_id)))
    placed = prefix_totals(keyed, [], [F.col("_key").asc(), F.col(row_id).asc()], position="draw_pos")
    return placed.where(F.col("draw_pos") <= count).drop("_key")


def positive_sample(
    candidates: DataFrame, tailings: DataFrame | None = None, divisor: int = 10, seed: int = 1, row_id: str = "cand_id"
) -> DataFrame:
    """floor(n / divisor) candidates; those touching ``tailings`` are removed after the draw."""
    if divisor <= 0:
        raise ValueError("the divisor must be positive")
    count = candidates.count() // divisor
    if count < 1:
        raise ValueError("too few candidates for the divisor")
    drawn = hash_draw(candidates, row_id, count, seed, "positive")
    if tailings is not None:
        drawn = polygons.outside(drawn, tailings, row_id)
    return number_rows(drawn, "draw_pos", "P%07d", "sample_id").drop("draw_pos")
