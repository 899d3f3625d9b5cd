"""Raster layers as pixel tables: sampling, stacks, summaries and checks.

pixels: (raster, r, c, value). meta: (raster, a, b, c0, d, e, f0, width,
height, nodata, crs) with x = a*col + b*row + c0 and y = d*col + e*row + f0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.priors import finite
from stratafold.operators.ordering import small_side

# Relative and absolute tolerance when a value is compared with nodata (fixed values).
NODATA_RTOL, NODATA_ATOL = 1e-5, 1e-8


def mask_nodata(value: Column, nodata: Column) -> Column:
    """NULL for NaN, infinities and values close to nodata."""
    clean = finite(value)
    close = F.abs(clean - nodata) <= F.lit(NODATA_ATOL) + F.lit(NODATA_RTOL) * F.abs(nodata)
    return F.when(F.coalesce(close, F.lit(False)), F.lit(None)).otherwise(clean)


def row_col(x: str, y: str) -> tuple[Column, Column]:
    """Pixel row and column of a coordinate by the inverse affine transform."""
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    dx, dy = F.col(x) - F.col("c0"), F.col(y) - F.col("f0")
    col = F.floor((F.col("e") * dx - F.col("b") * dy) / det).cast("bigint")
    row = F.floor((F.col("a") * dy - F.col("d") * dx) / det).cast("bigint")
    return row, col


def pixel_centres(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    joined = pixels.join(small_side(meta), "raster")
    col, row = F.col("c") + 0.5, F.col("r") + 0.5
    return joined.select(
        *pixels.columns,
        (F.col("a") * col + F.col("b") * row + F.col("c0")).alias("x"),
        (F.col("d") * col + F.col("e") * row + F.col("f0")).alias("y"),
    )


def sample(points: DataFrame, pixels: DataFrame, meta: DataFrame, point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """(point_id, raster, r, c, inside, value): one row per point and raster, NULL outside or at nodata."""
    row, col = row_col(x, y)
    placed = _per_raster(points.select(point_id, x, y), meta)
    placed = placed.withColumn("r", row).withColumn("c", col)
    inside = F.col("r").between(F.lit(0), F.col("height") - 1) & F.col("c").between(F.lit(0), F.col("width") - 1)
    placed = placed.select(point_id, "raster", "r", "c", "nodata", inside.alias("inside"))
    values = pixels.select("raster", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "value")
    joined = placed.join(small_side(values), ["raster", "r", "c"], "left")
    return joined.select(
        point_id, "raster", "r", "c", "inside", F.when(F.col("inside"), mask_nodata(F.col("value"), F.col("nodata"))).alias("value")
    )


def _per_raster(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Every point once per raster: the layer list is a literal array, not a join."""
    layers = meta.select("raster", "a", "b", "c0", "d", "e", "f0", "width", "height", "nodata").collect()
    rows = F.array(*[
        F.struct(*[F.lit(v).cast("string" if n == "raster" else "double").alias(n) for n, v in layer.asDict().items()])
        for layer in layers
    ])
    return points.select("*", F.inline(rows))


def stack(pixels: DataFrame, names: Sequence[str], nodata: float | None = None) -> DataFrame:
    """Aligned layers side by side: (r, c, one column per raster), one shuffle for all layers."""
    value = mask_nodata(F.col("value"), F.lit(nodata)) if nodata is not None else finite(F.col("value"))
    wanted = pixels.where(F.col("raster").isin(list(names)))
    return wanted.groupBy("r", "c").agg(
        *[F.first(F.when(F.col("raster") == n, value), ignorenulls=True).alias(n) for n in names]
    )


def feature_matrix(
    points: DataFrame, pixels: DataFrame, meta: DataFrame, point_id: str, names: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Points with one column per raster. Layers on one grid are stacked first, so points move once."""
    frames = meta.where(F.col("raster").isin(list(names))).select("a", "b", "c0", "d", "e", "f0", "nodata").distinct().collect()
    if len(frames) == 1:
        grid = frames[0]
        row, col = row_col(x, y)
        placed = points.select("*", *[F.lit(grid[n]).alias(n) for n in ("a", "b", "c0", "d", "e", "f0")])
        placed = placed.select(*points.columns, row.alias("r"), col.alias("c"))
        layers = stack(pixels, names, grid["nodata"]).select(
            F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), *names)
        return placed.join(small_side(layers), ["r", "c"], "left").select(*points.columns, *names)
    tall = sample(points, pixels, meta.where(F.col("raster").isin(list(names))), point_id, x, y)
    wide = tall.groupBy(point_id).agg(
        *[F.first(F.when(F.col("raster") == n, F.col("value")), ignorenulls=True).alias(n) for n in names])
    return points.join(wide, point_id, "left")


def covered(matrix: DataFrame, names: Sequence[str], out: str = "covered") -> DataFrame:
    """Flag rows with a value in every raster."""
    full = F.lit(True)
    for name in names:
        full = full & F.col(name).isNotNull()
    return matrix.withColumn(out, full)


def summary(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    clean = pixels.join(small_side(meta.select("raster", "nodata")), "raster").withColumn("v", mask_nodata(F.col("value"), F.col("nodata")))
    agg = clean.groupBy("raster").agg(
        F.count("*").alias("total"), F.count("v").alias("valid"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    return agg.select("raster", "total", "valid", (F.col("valid") / F.col("total").cast("double")).alias("valid_ratio"), "min", "max", "mean")


def overview(pixels: DataFrame, meta: DataFrame, max_size: int) -> DataFrame:
    """Block means on a coarser grid whose longer side is at most ``max_size``, clipped to [0, 1]."""
    joined = pixels.join(small_side(meta.select("raster", "width", "height", "nodata")), "raster")
    factor = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / F.lit(float(max_size)))).cast("bigint")
    value = mask_nodata(F.col("value"), F.col("nodata"))
    clipped = F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return joined.groupBy(
        "raster", F.floor(F.col("r") / factor).cast("bigint").alias("r"), F.floor(F.col("c") / factor).cast("bigint").alias("c")
    ).agg(F.avg(clipped).alias("value"), F.count(clipped).alias("cells"))


def alignment(meta: DataFrame, pixels: DataFrame, low: float = 0.0, high: float = 1.0, atol: float = 1e-6) -> DataFrame:
    """(raster, aligned, finite, in_range): same grid as the first layer, some value, values within bounds."""
    shape = F.struct("a", "b", "c0", "d", "e", "f0", "width", "height", "crs")
    first = meta.agg(F.min_by(shape, "raster").alias("_first"))
    ranges = summary(pixels, meta).select("raster", "valid", "min", "max")
    joined = meta.select("raster", shape.alias("_shape")).join(F.broadcast(first)).join(ranges, "raster", "left")  # first: one row
    inside = (F.col("min") >= low - atol) & (F.col("max") <= high + atol)
    return joined.select(
        "raster", (F.col("_shape") == F.col("_first")).alias("aligned"),
        (F.coalesce("valid", F.lit(0)) > 0).alias("finite"), F.coalesce(inside, F.lit(False)).alias("in_range"))


def scatter(grid: DataFrame, scores: DataFrame, value: str) -> DataFrame:
    """Scores back on the full grid, NULL where no cell was scored."""
    return grid.select("r", "c").join(scores.select("r", "c", value), ["r", "c"], "left")
