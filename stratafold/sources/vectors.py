"""Point and polygon layers: Parquet, CSV and GeoJSON in, Parquet and GeoJSON lines out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import geodesy
from stratafold.operators.topology import layer_problems

POINT_FEATURES = (
    "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>, "
    "crs struct<properties:struct<name:string>>"
)
POLYGON_FEATURES = (
    "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>, "
    "crs struct<properties:struct<name:string>>"
)
RINGS = "array<array<array<double>>>"
MANY_RINGS = "array<array<array<array<double>>>>"


def read_points(spark: SparkSession, path: str, columns: Sequence[str] = (), schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """x, y and the asked columns only, so that the scan reads nothing else."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    frame = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return require_points(frame.select("x", "y", *columns))


def require_points(frame: DataFrame) -> DataFrame:
    """Reject an empty layer or missing coordinates (one-row probes, no full pass)."""
    if not frame.take(1):
        raise ValueError("the point layer is empty")
    if frame.where(F.col("x").isNull() | F.col("y").isNull()).take(1):
        raise ValueError("the point layer has missing coordinates")
    return frame


def read_geojson_points(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """(x, y, properties, crs): any non-point geometry or missing CRS is an error."""
    raw = spark.read.schema(POINT_FEATURES).option("multiLine", True).json(path)
    rows = raw.select(F.coalesce(F.col("crs.properties.name"), F.lit(crs)).alias("crs"), F.explode("features").alias("f"))
    bad = F.raise_error(F.lit("a feature is not a point")).cast("double")
    ok = F.col("f.geometry.type") == "Point"
    out = rows.select(
        F.when(ok, F.col("f.geometry.coordinates")[0]).otherwise(bad).alias("x"), F.when(ok, F.col("f.geometry.coordinates")[1]).otherwise(bad).alias("y"),
        F.col("f.properties").alias("properties"), "crs")
    require_crs(out)
    return require_points(out)


def read_geojson_polygons(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """(zone_id, rings, crs): all rings of all parts of a feature, in file order."""
    raw = spark.read.schema(POLYGON_FEATURES).option("multiLine", True).json(path)
    rows = raw.select(F.coalesce(F.col("crs.properties.name"), F.lit(crs)).alias("crs"), F.posexplode("features").alias("zone_id", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    as_points = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    single, many = F.from_json(text, RINGS), F.flatten(F.from_json(text, MANY_RINGS))
    rings = F.when(kind == "Polygon", as_points(single)).when(kind == "MultiPolygon", as_points(many))
    out = rows.select(F.col("zone_id").cast("bigint").alias("zone_id"), rings.alias("rings"), "crs")
    require_crs(out)
    return require_polygons(out)


def require_polygons(zones: DataFrame) -> DataFrame:
    if not zones.take(1):
        raise ValueError("the polygon layer is empty")
    problem = layer_problems(zones).take(1)
    if problem:
        raise ValueError(f"invalid polygon {problem[0]['zone_id']}: {problem[0]['problem']}")
    return zones


def require_crs(frame: DataFrame) -> None:
    if frame.where(F.col("crs").isNull()).take(1):
        raise ValueError("the layer declares no CRS and none is assumed")


def require_metric_crs(frame: DataFrame) -> DataFrame:
    """Reject a layer that is not in metres: the CRS must be a UTM zone by name or code, and no zone's coordinates may pass for degrees."""
    named = geodesy.utm_zone(F.col("crs")).isNotNull() | F.regexp_like("crs", F.lit(r"(?i)\bepsg\W*32[67](0[1-9]|[1-5]\d|60)\b"))
    odd = frame.where(~F.coalesce(named, F.lit(False))).select("crs").take(1)
    if odd:
        raise ValueError(f"no metric CRS: {odd[0]['crs']}")
    if "rings" in frame.columns and frame.where(geodesy.plausible_lonlat(F.flatten("rings"))).take(1):
        raise ValueError("the coordinates of a zone look like degrees, not metres")
    return frame


def align_crs(zones: DataFrame, target: str) -> DataFrame:
    """Reproject rings between UTM zones through degrees; other CRS pairs are an error."""
    same = F.col("crs") == target
    source, goal = geodesy.utm_zone(F.col("crs")), geodesy.utm_zone(F.lit(target))

    def move(x: Column, y: Column) -> Column:
        there = geodesy.utm_to_lonlat(x, y, source["zone"], source["south"])
        return geodesy.lonlat_to_utm(there["lon"], there["lat"], goal["zone"], goal["south"])

    unknown = F.raise_error(F.concat(F.lit("no reprojection from "), F.col("crs"))).cast(zones.schema["rings"].dataType)
    rings = F.when(same, F.col("rings")).when(source.isNull() | goal.isNull(), unknown).otherwise(geodesy.map_vertices(F.col("rings"), move))
    return zones.withColumn("rings", rings).withColumn("crs", F.lit(target))


def feature_json(properties: Sequence[str], x: str = "x", y: str = "y") -> Column:
    """One GeoJSON feature of a point row as text."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates")).alias("geometry")))


def write_points(frame: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Parquet partitioned by the given columns, or GeoJSON lines; an existing target is an error."""
    if fmt == "parquet":
        frame.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    elif fmt == "geojson":
        names = [c for c in frame.columns if c not in ("x", "y")]
        frame.select(feature_json(names).alias("value")).write.mode("errorifexists").text(path)
    else:
        raise ValueError(f"unknown vector format: {fmt}")


def feature_collection(zones: DataFrame, order: str = "zone_id") -> DataFrame:
    """Every record as one GeoJSON feature, beside the number and the bounds of all records."""
    points = F.flatten("rings")
    low = lambda c: F.array_min(F.transform(points, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(points, lambda p: p[c]))
    whole = zones.agg(
        F.count("*").alias("records_total"), F.min(low("y")).alias("south"), F.min(low("x")).alias("west"),
        F.max(high("y")).alias("north"), F.max(high("x")).alias("east"))
    shapes = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col(order).alias("fid")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), shapes.alias("coordinates")).alias("geometry")))
    return zones.select(order, feature.alias("feature")).join(F.broadcast(whole))  # one row
