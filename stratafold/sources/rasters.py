"""Raster layers as Parquet pixel tables partitioned by layer name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Pixels of the named layers; the layer is a partition column, so others are not read."""
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    frame = None
    for path in paths:
        part = spark.read.parquet(path).select("raster", "r", "c", "value")
        frame = part if frame is None else frame.unionByName(part)
    return frame if names is None else frame.where(F.col("raster").isin(list(names)))


def write_pixels(pixels: DataFrame, path: str) -> None:
    pixels.repartitionByRange("raster", "r", "c").write.mode("errorifexists").partitionBy("raster").parquet(path)


def layer_names(pixels: DataFrame) -> DataFrame:
    return pixels.select("raster").distinct()


def match_layers(names: DataFrame, pattern: str, column: str = "raster") -> DataFrame:
    """Names equal to the pattern, or, without one, names whose stem contains any of its comma tokens."""
    wanted = pattern.strip().lower()
    if not wanted:
        raise ValueError("the layer pattern is empty")
    name = F.lower(column)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    tokens = [t.strip() for t in wanted.split(",") if t.strip()]
    test = F.lit(False)
    for token in tokens:
        test = test | stem.contains(token)
    marked = names.select(column).distinct().select(column, (name == wanted).alias("exact"), test.alias("partial"))
    any_exact = marked.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any_exact"))
    joined = marked.join(F.broadcast(any_exact))  # one row
    return joined.where(F.col("exact") | (~F.col("any_exact") & F.col("partial"))).select(column)


def find_layer(names: DataFrame, pattern: str, column: str = "raster") -> str:
    """The one matching layer; none or several is an error."""
    found = match_layers(names, pattern, column).take(2)
    if len(found) != 1:
        raise ValueError(f"{'several layers match' if found else 'no layer matches'} {pattern!r}")
    return found[0][0]
