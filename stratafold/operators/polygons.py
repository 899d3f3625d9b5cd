"""Points against polygon layers: membership, zone assignment and exact distance.

A zone row is (zone_id, rings ARRAY<ARRAY<STRUCT<x,y>>>). Zones are cut into
horizontal bands of few edges, each band is filed under the cells of a grid
level that fits its size, and points meet bands by an equi join on
(level, cell). A point then tests only the edges of its own band.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators.ordering import shuffled, small_side
from stratafold.session import cut, int_conf

EDGES_PER_BAND = 64
# Layers of at most this many edges are tested inside the projection, without a join.
INLINE_EDGES_KEY = "spark.stratafold.inlineEdges"
INLINE_EDGES_DEFAULT = 4096
# Edges of an average tile of a large layer, and the most edges and points that are looked at together.
TILE_EDGES, MOST_EDGES, MOST_POINTS = 1_000, 100_000, 50_000
MOST_TILES = 256  # along an axis
# A point this close to a zone still belongs to it when zones are assigned (fixed value).
ASSIGN_TOLERANCE = 0.01


def rectangles(df: DataFrame, zone_id: str = "zone_id") -> DataFrame:
    """Zones from x1, y1, x2, y2 columns as one closed counter-clockwise ring each."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    return df.select(F.col(zone_id).alias("zone_id"), F.array(ring).alias("rings"))


def ring_area(ring: Column) -> Column:
    """Signed area (positive counter-clockwise) of a closed ring."""
    pairs = F.transform(
        F.slice(ring, 1, F.size(ring) - 1),
        lambda p, i: p["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * p["y"],
    )
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / 2.0


def with_edges(zones: DataFrame) -> DataFrame:
    """Add edges (with the turn of their ring: 1 counter-clockwise, -1 clockwise) and bounds."""
    turn = F.transform("rings", lambda r: F.when(ring_area(r) < 0, -1).otherwise(1))
    edges = F.flatten(F.transform(
        F.arrays_zip(F.col("rings").alias("ring"), turn.alias("turn")),
        lambda z: F.transform(
            F.slice(z["ring"], 1, F.size(z["ring"]) - 1),
            lambda p, i: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"),
                F.get(z["ring"], i + 1)["x"].alias("x2"), F.get(z["ring"], i + 1)["y"].alias("y2"),
                z["turn"].alias("turn"),
            ),
        ),
    ))
    out = zones.withColumn("edges", edges)
    low = lambda c: F.array_min(F.transform("edges", lambda e: e[c]))
    high = lambda c: F.array_max(F.transform("edges", lambda e: e[c]))
    return out.select(
        "*", low("x1").alias("min_x"), low("y1").alias("min_y"), high("x1").alias("max_x"), high("y1").alias("max_y")
    )


def _level(extent: Column) -> Column:
    """Cell size as an even power of two at or above an extent: few different sizes, at most three cells an extent."""
    return (2 * F.ceil(F.log2(F.greatest(extent, F.lit(1e-6))) / 2)).cast("int")


def _cells(level: Column, lo: Column, hi: Column) -> Column:
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def bands(zones: DataFrame, pad: float = 0.0) -> DataFrame:
    """(zone_id, bounds, edges, level_x, level_y, cx, cy): bands of about 64 edges, at most 3 x 3 cells each.

    Cells are as wide as the zone but only as high as the band, so a point's
    cell holds a handful of a zone's bands however many it has. Edges are
    dealt to the bands they reach one by one; no band scans all edges.
    """
    base = with_edges(zones).withColumn("n_bands", F.ceil(F.size("edges") / F.lit(EDGES_PER_BAND)).cast("int"))
    base = base.withColumn("height", (F.col("max_y") - F.col("min_y")) / F.col("n_bands"))
    bounds = ["zone_id", "min_x", "min_y", "max_x", "max_y", "n_bands", "height"]
    edges = base.select(*bounds, F.explode("edges").alias("e"))
    place = lambda y: F.least(F.greatest(F.floor((y - F.col("min_y")) / F.col("height")), F.lit(0)), F.col("n_bands") - 1).cast("int")
    # A band further on either side covers rounding at the borders; a flat zone has one band.
    first = F.when(F.col("height") > 0, F.greatest(place(F.least("e.y1", "e.y2") - pad) - 1, F.lit(0))).otherwise(0)
    last = F.when(F.col("height") > 0, F.least(place(F.greatest("e.y1", "e.y2") + pad) + 1, F.col("n_bands") - 1)).otherwise(F.col("n_bands") - 1)
    dealt = edges.select("*", F.explode(F.sequence(first, last)).alias("band"))
    lo = F.col("min_y") + F.col("height") * F.col("band")
    hi = F.when(F.col("band") == F.col("n_bands") - 1, F.col("max_y")).otherwise(F.col("min_y") + F.col("height") * (F.col("band") + 1))
    dealt = dealt.withColumn("lo", lo - pad).withColumn("hi", hi + pad)
    dealt = dealt.where((F.greatest("e.y1", "e.y2") >= F.col("lo")) & (F.least("e.y1", "e.y2") <= F.col("hi")))
    out = dealt.groupBy(*bounds, "band", "lo", "hi").agg(F.collect_list("e").alias("edges")).select(
        "zone_id", (F.col("min_x") - pad).alias("min_x"), (F.col("max_x") + pad).alias("max_x"),
        "lo", "hi", (F.col("band") == F.col("n_bands") - 1).alias("top"), "edges",
        _level(F.col("max_x") - F.col("min_x") + 2 * pad).alias("level_x"), _level(F.col("hi") - F.col("lo")).alias("level_y"),
    )
    filed = out.select("*", F.explode(_cells(F.col("level_x"), F.col("min_x"), F.col("max_x"))).alias("cx"))
    return filed.select("*", F.explode(_cells(F.col("level_y"), F.col("lo"), F.col("hi"))).alias("cy"))


def _edge_gap2(e: Column, px: Column, py: Column) -> Column:
    """Squared distance from a point to one edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / F.when(len2 > 0, len2)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    qx, qy = px - (e["x1"] + t * dx), py - (e["y1"] + t * dy)
    return qx * qx + qy * qy


def _turn_on_edge(e: Column, px: Column, py: Column) -> Column:
    """0 off the edge; 1 or -1 on it: the side of the interior for a fixed line direction; 2 on a vertical fold or end."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    on = (
        (dx * (py - e["y1"]) - dy * (px - e["x1"]) == 0)
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    end = ((px == e["x1"]) & (py == e["y1"])) | ((px == e["x2"]) & (py == e["y2"]))
    forward = F.when((dx > 0) | ((dx == 0) & (dy > 0)), 1).otherwise(-1)
    return F.when(~on, 0).when(end, 2).otherwise(forward * e["turn"])


POSITION = {"interior": T.BooleanType(), "touches": T.BooleanType(), "distance": T.DoubleType(), "zone_id": T.LongType()}
# Pairs of a point and an edge looked at together: their arrays stay in the processor's cache.
PAIRS = 1 << 15


def inline_layer(zones: DataFrame, *wanted: str) -> Callable[[Column, Column], Column] | None:
    """A column function (x, y) -> the ``wanted`` fields of POSITION against the layer, or None unless it is proven small.

    Reads at most limit + 1 zones, and edges only of zones within the limit.
    Positions are computed batch-wise in NumPy inside the projection, so a
    small layer costs neither a join nor a shuffle of the points.
    """
    limit = int_conf(zones.sparkSession, INLINE_EDGES_KEY, INLINE_EDGES_DEFAULT)
    n = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r) - 1)
    rows = zones.select("zone_id", n.alias("n"), F.when(n <= limit, F.col("rings")).alias("rings")).limit(limit + 1).collect()
    if sum(r["n"] for r in rows) > limit or len(rows) > limit or not rows:
        return None
    rows.sort(key=lambda r: r["zone_id"])
    ids = np.array([r["zone_id"] for r in rows], dtype=np.int64)
    starts = np.cumsum([0] + [r["n"] for r in rows[:-1]])
    table = np.concatenate([_ring_edges(ring) for r in rows for ring in r["rings"]])

    @F.pandas_udf(T.StructType([T.StructField(name, POSITION[name]) for name in wanted]))
    def position(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        columns = _positions(x.to_numpy(dtype=float), y.to_numpy(dtype=float), table, starts, ids, wanted)
        return pd.DataFrame({n: pd.Series(c, dtype="float64").astype("Int64") if n == "zone_id" else c for n, c in columns.items()})

    return position


def _ring_edges(ring) -> np.ndarray:
    """x1, y1, x2, y2 and the turn of a closed ring, one row per edge."""
    p = np.array([(v["x"], v["y"]) for v in ring], dtype=float)
    area = (p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum()
    return np.column_stack([p[:-1], p[1:], np.full(len(p) - 1, -1.0 if area < 0 else 1.0)])


def _positions(xs, ys, table, starts, ids, wanted=tuple(POSITION)):
    """The ``wanted`` of interior, touch, distance and first zone of points.

    A zone is held only against points in its box, widened beyond the tolerance and rounding: elsewhere a ray crosses it
    an even number of times. A zone with a coordinate that is not finite meets every point.
    """
    interior, touches, left, right = (np.zeros(len(xs), dtype=bool) for _ in range(4))
    first = np.full(len(xs), np.nan)
    for zone, edges in zip(ids, np.split(table, starts[1:])):
        if not len(edges):
            continue
        lo, hi = np.minimum(edges[:, :2], edges[:, 2:4]).min(axis=0), np.maximum(edges[:, :2], edges[:, 2:4]).max(axis=0)
        pad = 2 * ASSIGN_TOLERANCE + 1e-9 * np.maximum(np.abs(lo), np.abs(hi)).max()
        lo, hi = (lo - pad, hi + pad) if np.isfinite(edges).all() else (np.full(2, -np.inf), np.full(2, np.inf))
        here = np.flatnonzero((xs >= lo[0]) & (xs <= hi[0]) & (ys >= lo[1]) & (ys <= hi[1]))
        step = max(1, PAIRS // len(edges))
        for i in range(0, len(here), step):
            own = here[i:i + step]
            odd, border, sides = _hits(xs[own, None], ys[own, None], edges)
            interior[own] |= odd & ~border
            touches[own] |= odd | border
            left[own] |= (sides == 1).any(axis=1)
            right[own] |= (sides == -1).any(axis=1)
            if "zone_id" in wanted:
                near = odd | (_gaps2(xs[own, None], ys[own, None], edges).min(axis=1) <= ASSIGN_TOLERANCE**2)
                own = own[near & np.isnan(first[own])]
                first[own] = zone
    out = {"interior": interior | (left & right), "touches": touches, "zone_id": first}
    if "distance" in wanted:
        gaps2, step = np.zeros(len(xs)), max(1, PAIRS // len(table))
        away = np.flatnonzero(~touches)
        for i in range(0, len(away), step):
            own = away[i:i + step]
            gaps2[own] = _gaps2(xs[own, None], ys[own, None], table).min(axis=1)
        out["distance"] = np.sqrt(gaps2)
    return {name: out[name] for name in wanted}


def _hits(px, py, edges):
    """Of points against one zone: inside by crossings, on its border, and the side of the interior on an edge (0 off it and at its ends)."""
    x1, y1, x2, y2, turn = edges.T
    dx, dy = x2 - x1, y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        crossing = ((y1 > py) != (y2 > py)) & (px < dx * (py - y1) / dy + x1)
    on = (
        (dx * (py - y1) - dy * (px - x1) == 0)
        & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2)) & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
    )
    end = ((px == x1) & (py == y1)) | ((px == x2) & (py == y2))
    side = np.where((dx > 0) | ((dx == 0) & (dy > 0)), 1, -1) * turn
    return crossing.sum(axis=1) % 2 == 1, on.any(axis=1), np.where(on & ~end, side, 0)


def _gaps2(px, py, edges):
    """Squared distances of points to edges."""
    x1, y1, x2, y2, _ = edges.T
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(len2 > 0, len2, 1.0), 0.0, 1.0)
    return (px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2


def _crossings(edges: Column, px: Column, py: Column) -> Column:
    """True when a ray from the point crosses the edges an odd number of times."""
    crossing = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (
        px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"]
    )
    return F.size(F.filter(edges, crossing)) % 2 == 1


def candidates(points: DataFrame, zones: DataFrame, x: str = "x", y: str = "y", pad: float = 0.0) -> DataFrame:
    """Point columns plus (zone_id, inside, turns, gap2) for each zone whose padded box holds the point."""
    filed = bands(zones, pad)
    # Sizes present are few (even powers of two of zone widths and band heights).
    levels = sorted((r[0], r[1]) for r in filed.select("level_x", "level_y").distinct().collect()) or [(0, 0)]
    lookup = small_side(filed, F.size("edges") + 1)
    px, py = F.col(x), F.col(y)
    sizes = F.array(*[F.struct(F.lit(a).alias("level_x"), F.lit(b).alias("level_y")) for a, b in levels])
    placed = points.select("*", F.explode(sizes).alias("_l")).select("*", F.col("_l.level_x").alias("_level_x"), F.col("_l.level_y").alias("_level_y")).drop("_l")
    placed = placed.withColumn("_cx", F.floor(px / F.pow(F.lit(2.0), F.col("_level_x"))).cast("bigint"))
    placed = placed.withColumn("_cy", F.floor(py / F.pow(F.lit(2.0), F.col("_level_y"))).cast("bigint"))
    cell = ["level_x", "level_y", "cx", "cy"]
    joined = placed.join(lookup.withColumnsRenamed({c: f"_{c}" for c in cell}), [f"_{c}" for c in cell])
    # Half-open bands, so that without padding a point meets one band of a zone.
    in_band = (py >= F.col("lo")) & ((py < F.col("hi")) | (F.col("top") & (py <= F.col("hi"))))
    if pad:
        in_band = py.between(F.col("lo"), F.col("hi"))
    near = joined.where(px.between(F.col("min_x"), F.col("max_x")) & in_band)
    odd = _crossings(F.col("edges"), px, py)
    turns = F.filter(F.transform("edges", lambda e: _turn_on_edge(e, px, py)), lambda t: t != 0)
    gap2 = F.array_min(F.transform("edges", lambda e: _edge_gap2(e, px, py)))
    out = near.select(*points.columns, "zone_id", odd.alias("odd"), turns.alias("turns"), (gap2 if pad else F.lit(None).cast("double")).alias("gap2"))
    return out.withColumn("inside", F.col("odd") & (F.size("turns") == 0))


def membership(points: DataFrame, zones: DataFrame, point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """(point_id, interior, touches): position against the union of all zones.

    Only points that hit a zone appear. ``interior`` excludes the boundary of
    the union; a point on a border shared by two zones on opposite sides is
    interior to the union. ``touches`` includes the boundary.
    """
    layer = inline_layer(zones, "interior", "touches")
    if layer is not None:
        placed = points.select(point_id, layer(F.col(x), F.col(y)).alias("_p"))
        return placed.where("_p.touches").select(point_id, "_p.interior", "_p.touches")
    hits = candidates(points.select(point_id, x, y), zones, x, y).where(F.col("inside") | (F.size("turns") > 0))
    agg = hits.groupBy(point_id).agg(
        F.bool_or("inside").alias("_in"),
        F.bool_or(F.array_contains("turns", 1)).alias("_left"),
        F.bool_or(F.array_contains("turns", -1)).alias("_right"),
    )
    return agg.select(
        point_id, (F.col("_in") | (F.col("_left") & F.col("_right"))).alias("interior"), F.lit(True).alias("touches")
    )


def within(points: DataFrame, zones: DataFrame, point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points strictly inside the union."""
    layer = inline_layer(zones, "interior")
    if layer is not None:
        return points.where(layer(F.col(x), F.col(y))["interior"])
    hit = membership(points, zones, point_id, x, y).where("interior").select(point_id)
    return points.join(shuffled(hit), point_id, "left_semi")


def outside(points: DataFrame, zones: DataFrame, point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points that do not intersect the union, boundary included in the exclusion."""
    layer = inline_layer(zones, "touches")
    if layer is not None:
        return points.where(~layer(F.col(x), F.col(y))["touches"])
    hit = membership(points, zones, point_id, x, y).select(point_id)
    return points.join(shuffled(hit), point_id, "left_anti")


def flag(points: DataFrame, zones: DataFrame, point_id: str, out: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add a boolean: strictly inside the union."""
    layer = inline_layer(zones, "interior")
    if layer is not None:
        return points.withColumn(out, layer(F.col(x), F.col(y))["interior"])
    hit = membership(points, zones, point_id, x, y).where("interior").select(point_id, F.lit(True).alias(out))
    return points.join(shuffled(hit), point_id, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def assign_zone(
    points: DataFrame, zones: DataFrame, point_id: str, x: str = "x", y: str = "y", tolerance: float = ASSIGN_TOLERANCE
) -> DataFrame:
    """Add zone_id: the first zone (smallest id) within the tolerance, NULL when none."""
    layer = inline_layer(zones, "zone_id") if tolerance == ASSIGN_TOLERANCE else None
    if layer is not None:
        return points.withColumn("zone_id", layer(F.col(x), F.col(y))["zone_id"].cast(zones.schema["zone_id"].dataType))
    near = candidates(points.select(point_id, x, y), zones, x, y, pad=tolerance)
    hit = near.where(F.col("odd") | (F.col("gap2") <= tolerance * tolerance))
    first = hit.groupBy(point_id).agg(F.min("zone_id").alias("zone_id"))
    return points.join(shuffled(first), point_id, "left")


def add_distance(points: DataFrame, zones: DataFrame, point_id: str, out: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add the exact distance to the union of zones, 0 inside.

    Most points find their nearest edge in their own tile, which also holds the
    edges near its border, and with it whether a zone no larger than a tile holds
    them. For the others edges are cut into pieces and filed in a grid pyramid,
    whose cells know the box of what they hold. Cells of points, not points,
    search it from the top level down: of the cells reached, those stay whose
    nearest corner is no farther than the farthest of the best one, then their
    four children are looked at. A far cell so follows a few cells a level,
    however many edges lie behind them. The pieces of the last cells are held to
    the same bound.
    """
    layer = inline_layer(zones, "distance")
    if layer is not None:
        return points.withColumn(out, layer(F.col(x), F.col(y))["distance"])
    edges = zones.select(F.xxhash64("zone_id").alias("zone"), "rings").mapInArrow(_edge_rows, EDGE_ROW)
    span = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    box = edges.agg(
        F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2")),
        F.count("*"), F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))),
    ).first()
    if box[4] == 0 or span[0] is None:
        return points.withColumn(out, F.lit(None).cast("double"))
    # Rows without an id or a place have no distance.
    placed = points.select(point_id, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop()
    settled, rest, unmet = _tile_distances(placed, zones, edges, point_id, box)
    nearest = settled
    if not rest.isEmpty():
        nearest = nearest.unionByName(_pyramid_distances(rest, edges.select("x1", "y1", "x2", "y2").distinct(), point_id, span, box))
    nearest = nearest.groupBy(point_id).agg(F.min("_d").alias(out))
    if unmet.isEmpty():
        return points.join(shuffled(nearest), point_id, "left")
    inside = membership(points, unmet, point_id, x, y).select(point_id, F.lit(0.0).alias("_zero"))
    return (
        points.join(shuffled(nearest), point_id, "left").join(shuffled(inside), point_id, "left")
        .withColumn(out, F.coalesce(F.col("_zero"), F.col(out))).drop("_zero")
    )


EDGE_ROW = "zone bigint, known boolean, bx1 double, by1 double, bx2 double, by2 double, x1 double, y1 double, x2 double, y2 double"


def ring_points(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of zones in Arrow: the zone of each ring, the ring of each point, its place in the ring, x and y (NaN for NULL)."""
    lengths = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    zone_of = np.repeat(np.arange(len(rings)), lengths(rings))
    listed = rings.flatten()
    sizes = lengths(listed)
    ring_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ring_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    points = listed.flatten()
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in (points.flatten()[points.type.get_field_index(n)] for n in "xy"))
    return zone_of, ring_of, place, x, y


def _zone_boxes(rings: pa.ListArray):
    """Zone, start and end of each edge, and of each zone its edges, whether all their ends are known, and their box."""
    zone_of, ring_of, place, x, y = ring_points(rings)
    start = np.flatnonzero(place[1:] > 0)
    zone, end = zone_of[ring_of[start]], start + 1
    count = np.bincount(zone, minlength=len(rings))
    boxes, known = np.full((len(rings), 4), np.nan), count > 0
    if len(start):
        begins, some = np.flatnonzero(np.append(True, zone[1:] != zone[:-1])), np.flatnonzero(count)
        for i, (values, least) in enumerate(((x, np.minimum), (y, np.minimum), (x, np.maximum), (y, np.maximum))):
            boxes[some, i] = least.reduceat(least(values[start], values[end]), begins)
        known = known & ~np.isnan(boxes).any(axis=1)
    return zone, start, end, x, y, count, known, boxes


def _edge_rows(batches):
    """Edges with both ends known as EDGE_ROW. Zones of one hashed id, box and number of bands share their number, as in :func:`bands`."""
    for batch in batches:
        zone, start, end, x, y, count, known, boxes = _zone_boxes(batch.column("rings"))
        number = batch.column("zone").to_numpy(zero_copy_only=False) ^ (-(-count // EDGES_PER_BAND)).astype("int64") * 0x9E3779B97F4A7C1
        columns = [x[start], y[start], x[end], y[end]]
        kept = ~np.isnan(columns).any(axis=0)
        columns = [number[zone], known[zone], *boxes[zone].T, *columns]
        names = [c.split()[0] for c in EDGE_ROW.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=names)


def _not_within(batches, side: float):
    """Zones that a tile does not hold whole."""
    for batch in batches:
        *_, count, known, boxes = _zone_boxes(batch.column("rings"))
        whole = known & (boxes[:, 2] - boxes[:, 0] <= side) & (boxes[:, 3] - boxes[:, 1] <= side)
        yield batch.filter(pa.array((count > 0) & ~whole))


def _tile_distances(placed: DataFrame, zones: DataFrame, edges: DataFrame, point_id: str, box) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, _d) of points whose nearest edge is proven by their tile, the other points, and the zones still to be met.

    A tile holds the edges in and near it. A zone no larger than a tile is filed whole, so that it is also known which
    points it holds; of larger ones pieces of edges are filed. A tile with too many edges settles nothing, points of a
    crowded tile are looked at in parts.
    """
    ox, oy = box[0], box[1]
    along = max(1, min(MOST_TILES, int((box[4] / TILE_EDGES) ** 0.5)))
    side = max(box[2] - ox, box[3] - oy, 1e-6) / along
    halo = side / 8
    tile = lambda v, o: F.floor((v - o) / side).cast("int")
    tiles = lambda lo, hi, o: F.explode(F.sequence(tile(lo - halo, o), tile(hi + halo, o)))
    ends = ("x1", "y1", "x2", "y2")
    bounds = ("bx1", "by1", "bx2", "by2")
    whole = F.col("known") & (F.col("bx2") - F.col("bx1") <= side) & (F.col("by2") - F.col("by1") <= side)
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / side)).cast("int")
    parts = edges.withColumn("whole", whole).select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("whole"), 1).otherwise(steps))).alias("_i"), steps.alias("_k"))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_k"))

    def reach(a: str, b: str, low: str, high: str, o: float) -> Column:
        ends = [at(a, b, F.col("_i") - 1), at(a, b, F.col("_i"))]
        return tiles(F.when(F.col("whole"), F.col(low)).otherwise(F.least(*ends)), F.when(F.col("whole"), F.col(high)).otherwise(F.greatest(*ends)), o)

    filed = parts.select("*", reach("x1", "x2", "bx1", "bx2", ox).alias("tx")).select("*", reach("y1", "y2", "by1", "by2", oy).alias("ty")).select(
        "tx", "ty", "zone", *[F.when(F.col("whole"), F.col(c)).alias(c) for c in bounds], *ends)

    places = placed.select(point_id, "_x", "_y", tile(F.col("_x"), ox).alias("tx"), tile(F.col("_y"), oy).alias("ty"))
    inside = F.col("tx").between(0, along) & F.col("ty").between(0, along)
    edges_in = {(r["tx"], r["ty"]): r["count"] for r in filed.where(inside).groupBy("tx", "ty").count().collect()}  # at most MOST_TILES ** 2
    points_in = {(r["tx"], r["ty"]): r["count"] for r in places.where(inside).groupBy("tx", "ty").count().collect()}
    used = [(*t, -(-n // MOST_POINTS)) for t, n in points_in.items() if 0 < edges_in.get(t, 0) <= MOST_EDGES]
    spark = placed.sparkSession
    folds = F.broadcast(spark.createDataFrame(used, "tx int, ty int, folds int"))  # at most MOST_TILES ** 2 rows
    left = places.join(folds, ["tx", "ty"]).select(
        point_id, "_x", "_y", F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.pmod(F.xxhash64(point_id, "_x", "_y"), "folds").cast("int").alias("_fold"))
    right = filed.join(folds, ["tx", "ty"]).select(
        F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), "zone", *bounds, *ends, F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("_fold"))

    def search(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = asked[[point_id, "_x", "_y"]]
        if not len(found) or not len(held):
            return found.assign(_d=np.nan, settled=False)
        px, py = (found[c].to_numpy(dtype=float) for c in ("_x", "_y"))
        gaps = _nearest_in_tile(px, py, held)
        x1, y1 = ox + float(key[0]) * side, oy + float(key[1]) * side
        # An edge that is not here is farther than the halo around the tile.
        margin = (halo + np.minimum(np.minimum(px - x1, x1 + side - px), np.minimum(py - y1, y1 + side - py))) * (1 - 1e-6)
        return found.assign(_d=gaps, settled=gaps <= margin)

    schema = T.StructType([placed.schema[point_id], placed.schema["_x"], placed.schema["_y"], T.StructField("_d", T.DoubleType()), T.StructField("settled", T.BooleanType())])
    keys = ("_tx", "_ty", "_fold")
    # Tiles are few bytes and much work: their tasks are not merged.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    missed = places.join(folds, ["tx", "ty"], "left_anti").select(point_id, "_x", "_y", F.lit(None).cast("double").alias("_d"), F.lit(False).alias("settled"))
    found = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema).unionByName(missed))
    # Points of tiles with too many edges have met no zone yet.
    crowded = any(edges_in.get(t, 0) > MOST_EDGES for t in points_in)
    unmet = zones.select("zone_id", "rings")
    if not crowded:
        unmet = unmet.mapInArrow(lambda it: _not_within(it, side), unmet.schema)
    return found.where("settled").select(point_id, "_d"), found.where("not settled").select(point_id, "_x", "_y"), unmet


def _nearest_in_tile(px: np.ndarray, py: np.ndarray, held: pd.DataFrame) -> np.ndarray:
    """Distances of points to the nearest of the edges held, 0 in or on a zone that is held whole.

    Neighbouring points are looked at together, with the edges that may be nearest to one of them and the zones whose
    boxes meet theirs.
    """
    held = held.sort_values(["zone", "bx1", "by1", "bx2", "by2"], kind="stable")
    edges, boxes, zone = held[["x1", "y1", "x2", "y2"]].to_numpy(), held[["bx1", "by1", "bx2", "by2"]].to_numpy(), held["zone"].to_numpy()
    edges = np.column_stack([edges, np.ones(len(edges))])
    # Edges of one zone follow each other; those of parts have no box and no zone.
    other = np.append(True, (zone[1:] != zone[:-1]) | (boxes[1:] != boxes[:-1]).any(axis=1))
    number = np.cumsum(other)
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:4]), np.maximum(edges[:, :2], edges[:, 2:4])
    strips = max(1, int((len(px) / 128) ** 0.5))
    strip = np.floor((py - py.min()) / max(np.ptp(py), 1e-300) * strips)
    order, out = np.lexsort((px, strip)), np.empty(len(px))
    for i in range(0, len(px), 128):
        own = order[i:i + 128]
        x, y = px[own, None], py[own, None]
        ax, ay, bx, by = x.min(), y.min(), x.max(), y.max()
        gx, gy = np.maximum(0.0, np.maximum(lo[:, 0] - bx, ax - hi[:, 0])), np.maximum(0.0, np.maximum(lo[:, 1] - by, ay - hi[:, 1]))
        rx, ry = np.maximum(np.abs(hi[:, 0] - ax), np.abs(bx - lo[:, 0])), np.maximum(np.abs(hi[:, 1] - ay), np.abs(by - lo[:, 1]))
        cap = (rx * rx + ry * ry).min() * (1 + 1e-9)
        near = np.flatnonzero(gx * gx + gy * gy <= cap)
        gaps2, step = np.full(len(own), np.inf), max(1, PAIRS // len(own))
        for j in range(0, len(near), step):
            gaps2 = np.minimum(gaps2, _gaps2(x, y, edges[near[j:j + step]]).min(axis=1))
        around = np.flatnonzero((boxes[:, 0] <= bx) & (boxes[:, 2] >= ax) & (boxes[:, 1] <= by) & (boxes[:, 3] >= ay))
        while len(around):
            # Whole zones of at most about PAIRS pairs at a time.
            ends = int(np.searchsorted(number[around], number[around[min(len(around) - 1, step)]], side="left")) or int(np.searchsorted(number[around], number[around[0]], side="right"))
            ends = len(around) if len(around) <= step else ends
            part, around = around[:ends], around[ends:]
            x1, y1, x2, y2, _ = edges[part].T
            dx, dy = x2 - x1, y2 - y1
            with np.errstate(divide="ignore", invalid="ignore"):
                crossing = ((y1 > y) != (y2 > y)) & (x < dx * (y - y1) / dy + x1)
            on = ((dx * (y - y1) - dy * (x - x1) == 0) & (x >= lo[part, 0]) & (x <= hi[part, 0]) & (y >= lo[part, 1]) & (y <= hi[part, 1])).any(axis=1)
            starts = np.flatnonzero(np.append(True, number[part[1:]] != number[part[:-1]]))
            odd = (np.add.reduceat(crossing, starts, axis=1, dtype=np.int64) % 2 == 1).any(axis=1)
            gaps2[odd | on] = 0.0
        out[own] = np.sqrt(gaps2)
    return out


def _pyramid_distances(points: DataFrame, edges: DataFrame, point_id: str, span, box) -> DataFrame:
    """(id, _d) of points (id, _x, _y) by the pyramid of :func:`add_distance`."""
    ox, oy = min(span[0], box[0]), min(span[1], box[1])
    extent = max(max(span[2], box[2]) - ox, max(span[3], box[3]) - oy, 1e-6)
    # Finest cells: about one edge each on a square layout, no smaller than edges are on average; the pyramid ends at one cell.
    depth = 1
    while 4 ** (depth - 1) < box[4] * 16 and extent / 2**depth >= (box[5] or 0.0):
        depth += 1
    fine = extent / 2 ** (depth - 1) * (1 + 1e-12)
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / fine)).cast("int")
    part = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_k"))
    pieces = edges.withColumn("_k", steps).select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
    i, j = F.col("_i").cast("double"), F.col("_i").cast("double") + 1
    pieces = pieces.select(
        "x1", "y1", "x2", "y2",
        F.least(part("x1", "x2", i), part("x1", "x2", j)).alias("bx1"), F.greatest(part("x1", "x2", i), part("x1", "x2", j)).alias("bx2"),
        F.least(part("y1", "y2", i), part("y1", "y2", j)).alias("by1"), F.greatest(part("y1", "y2", i), part("y1", "y2", j)).alias("by2"),
    )
    tiny = extent * 1e-9  # keeps a piece filed in every cell it may round into
    axis = lambda lo, hi, o: F.sequence(
        F.floor((F.col(lo) - tiny - o) / fine).cast("bigint"), F.floor((F.col(hi) + tiny - o) / fine).cast("bigint"))
    filed = pieces.select("*", F.explode(axis("bx1", "bx2", ox)).alias("fx")).select("*", F.explode(axis("by1", "by2", oy)).alias("fy"))
    filed = cut(filed)

    # Every occupied cell of every level with the box of what lies in it, each level from the one below.
    frame = [F.min("bx1").alias("bx1"), F.min("by1").alias("by1"), F.max("bx2").alias("bx2"), F.max("by2").alias("by2")]
    nodes = [cut(filed.groupBy(F.col("fx").alias("cx"), F.col("fy").alias("cy")).agg(*frame))]
    for _ in range(depth):
        half = [F.floor(F.col(c) / 2).cast("bigint").alias(c) for c in ("cx", "cy")]
        nodes.append(cut(nodes[-1].groupBy(*half).agg(*frame)))
    near = points.select(
        point_id, "_x", "_y", F.floor((F.col("_x") - ox) / fine).cast("bigint").alias("fx"), F.floor((F.col("_y") - oy) / fine).cast("bigint").alias("fy"))
    left, bottom = F.col("fx") * F.lit(fine) + ox, F.col("fy") * F.lit(fine) + oy
    right, top = left + fine, bottom + fine
    gap = lambda lo, hi, a, b: F.greatest(F.lit(0.0), F.col(lo) - b, a - F.col(hi))
    reach = lambda lo, hi, a, b: F.greatest(F.abs(F.col(hi) - a), F.abs(b - F.col(lo)))
    gx, gy = gap("bx1", "bx2", left, right), gap("by1", "by2", bottom, top)
    rx, ry = reach("bx1", "bx2", left, right), reach("by1", "by2", bottom, top)

    def can_win(found: DataFrame, kept: Sequence[str]) -> DataFrame:
        """Rows whose box may hold the nearest edge of some point of the cell (fx, fy)."""
        scored = found.select("fx", "fy", *kept, F.sqrt(gx * gx + gy * gy).alias("_near"), F.sqrt(rx * rx + ry * ry).alias("_far"))
        best = scored.groupBy("fx", "fy").agg(F.min("_far").alias("_cap"))
        return scored.join(shuffled(best), ["fx", "fy"]).where(F.col("_near") <= F.col("_cap") + 2 * tiny).select("fx", "fy", *kept)

    def at(level: int) -> DataFrame:
        return small_side(nodes[level])

    def offsets(base: Column, *of: int) -> Column:
        return F.explode(F.array(*[base + F.lit(i).cast("bigint") for i in of]))

    cells = near.select("fx", "fy").distinct()
    none = F.lit(0).cast("bigint")
    front = cells.withColumn("cx", offsets(none, -1, 0, 1)).withColumn("cy", offsets(none, -1, 0, 1))
    front = front.join(at(depth), ["cx", "cy"]).select("fx", "fy", "cx", "cy")
    for level in range(depth - 1, -1, -1):
        below = front.withColumn("cx", offsets(F.col("cx") * 2, 0, 1)).withColumn("cy", offsets(F.col("cy") * 2, 0, 1))
        front = cut(can_win(below.join(at(level), ["cx", "cy"]), ["cx", "cy"]))
    pieces = filed.select("x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2", F.col("fx").alias("cx"), F.col("fy").alias("cy"))
    winners = can_win(front.join(small_side(pieces), ["cx", "cy"]), ["x1", "y1", "x2", "y2"]).distinct()
    edge = F.struct("x1", "y1", "x2", "y2")
    gaps = near.join(shuffled(winners), ["fx", "fy"]).select(point_id, _edge_gap2(edge, F.col("_x"), F.col("_y")).alias("_g"))
    return gaps.groupBy(point_id).agg(F.sqrt(F.min("_g")).alias("_d"))


def bounds(df: DataFrame, keys: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")
    )


def within_bounds(df: DataFrame, boxes: DataFrame, keys: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Rows of ``df`` inside the box of their keys, edges included; without keys ``boxes`` is the one row of ``bounds``.

    A NULL coordinate, a box without points (NULL bounds) and keys without a box keep nothing.
    """
    named = boxes.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    met = df.join(named, list(keys)) if keys else df.join(F.broadcast(named))
    return met.where(F.col(x).between(F.col("_min_x"), F.col("_max_x")) & F.col(y).between(F.col("_min_y"), F.col("_max_y"))).select(*df.columns)


def dedupe(zones: DataFrame) -> DataFrame:
    """One zone per identical geometry (smallest id)."""
    return zones.groupBy(F.sha2(F.to_json("rings"), 256).alias("_shape")).agg(
        F.min_by(F.struct("zone_id", "rings"), "zone_id").alias("z")).select("z.*")


def ring_problems(zones: DataFrame) -> DataFrame:
    """(zone_id, problem): empty or NULL geometry, open ring, fewer than four points, no area, NULL vertex."""
    bad_vertex = F.exists("rings", lambda r: F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull()))
    checks = F.array_compact(F.array(
        F.when(F.col("rings").isNull() | (F.size("rings") == 0), F.lit("empty")),
        F.when(F.exists("rings", lambda r: F.size(r) < 4), F.lit("short")),
        F.when(F.exists("rings", lambda r: F.element_at(r, 1) != F.element_at(r, -1)), F.lit("open")),
        F.when(bad_vertex, F.lit("null vertex")),
        F.when(F.exists("rings", lambda r: (F.size(r) >= 4) & (ring_area(r) == 0)), F.lit("no area")),
    ))
    return zones.select("zone_id", F.explode(checks).alias("problem"))
