"""UTM <-> longitude/latitude (WGS84) by the fourth-order Krueger series in the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratafold.functions.keys import as_col

# WGS84 and UTM constants (fixed values).
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
EASTING = 500000.0
NORTHING_SOUTH = 10000000.0

N = FLATTENING / (2 - FLATTENING)
MERIDIAN = RADIUS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Series coefficients: forward, inverse and conformal-to-geodetic latitude.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def central_meridian(zone) -> Column:
    return F.radians(as_col(zone).cast("double") * 6 - 183)


def utm_to_lonlat(x, y, zone, south) -> Column:
    """struct(lon, lat) in degrees."""
    north = as_col(y) - F.when(as_col(south), NORTHING_SOUTH).otherwise(0.0)
    xi = north / F.lit(SCALE * MERIDIAN)
    eta = (as_col(x) - EASTING) / F.lit(SCALE * MERIDIAN)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta1 = eta1 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, start=1):
        lat = lat + F.lit(d) * F.sin(chi * (2 * j))
    lon = central_meridian(zone) + F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def lonlat_to_utm(lon, lat, zone, south) -> Column:
    """struct(x, y) in metres."""
    phi = F.radians(as_col(lat).cast("double"))
    dl = F.radians(as_col(lon).cast("double")) - central_meridian(zone)
    k = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(k) * F.atanh(F.lit(k) * F.sin(phi)))
    xi1 = F.atan2(t, F.cos(dl))
    eta1 = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(ALPHA, start=1):
        xi = xi + F.lit(a) * F.sin(xi1 * (2 * j)) * F.cosh(eta1 * (2 * j))
        eta = eta + F.lit(a) * F.cos(xi1 * (2 * j)) * F.sinh(eta1 * (2 * j))
    offset = F.when(as_col(south), NORTHING_SOUTH).otherwise(0.0)
    return F.struct(
        (F.lit(SCALE * MERIDIAN) * eta + EASTING).alias("x"), (F.lit(SCALE * MERIDIAN) * xi + offset).alias("y")
    )


# A zone number with its hemisphere letter, as written after the word "zone" in CRS texts.
ZONE_NAME = r"(?i)\bzone\W{0,3}0?([1-9]\d?)\W{0,2}([ns])\b"


def utm_zone(crs_text) -> Column:
    """struct(zone, south) read from CRS text, NULL when absent or outside 1..60."""
    plain = F.replace(as_col(crs_text), F.lit("_"), F.lit(" "))
    number, side = (F.nullif(F.regexp_extract(plain, ZONE_NAME, k), F.lit("")) for k in (1, 2))
    zone = number.try_cast("int")
    return F.when(zone.between(1, 60), F.struct(zone.alias("zone"), (F.lower(side) == "s").alias("south")))


def plausible_lonlat(points: Column) -> Column:
    """True when an array of struct(x, y) has vertices and all of them could be degrees, up to rounding."""
    slack = 1e-6
    inside = F.forall(points, lambda p: (F.abs(p["x"]) <= 180.0 + slack) & (F.abs(p["y"]) <= 90.0 + slack))
    return F.coalesce(F.size(points) > 0, F.lit(False)) & F.coalesce(inside, F.lit(False))


def map_vertices(rings: Column, fn) -> Column:
    """Apply ``fn(x, y) -> struct(x, y)`` to every vertex of nested rings."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: fn(p["x"], p["y"])))


def close_rings(parts: Column) -> Column:
    """Drop parts under two points, close open rings, keep rings of at least four points."""
    usable = F.filter(parts, lambda p: F.size(p) >= 2)
    closed = F.transform(
        usable, lambda p: F.when(F.element_at(p, 1) == F.element_at(p, -1), p).otherwise(F.concat(p, F.slice(p, 1, 1)))
    )
    return F.filter(closed, lambda p: F.size(p) >= 4)
