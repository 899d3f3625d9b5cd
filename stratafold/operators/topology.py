"""Validity of polygon layers: edges of a zone that cross, touch or fold back.

Every edge is filed under the cells of a grid as coarse as the edge is long, at most 2 x 2 of them, and looks into its
cells of every coarser grid in use, so two edges meet in the grid of the longer one and a join on (zone, grid, cell) finds
every pair whose boxes can meet. Small edges never meet by the thousand because a long one lies elsewhere in the zone.
Only large zones and those in several rows go that way: all others are decided inside their row, where edges are swept by x.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators.ordering import shuffled, small_side
from stratafold.operators.polygons import ring_points, ring_problems
from stratafold.session import cut, spread

POINTS = ("x1", "y1", "x2", "y2")
# Edges up to which a zone is decided inside its row, and pairs of edges looked at together.
ROW_EDGES = 10_000
PAIRS = 1 << 18
FOUND = "a_ring int, a_edge int, b_ring int, b_edge int"


def ring_edges(zones: DataFrame) -> DataFrame:
    """(zone_id, ring, edge, edges, x1, y1, x2, y2): edges of each ring in order, those without length left out."""
    rings = zones.select("zone_id", F.posexplode("rings").alias("ring", "_r"))
    ends = F.transform(F.slice("_r", 1, F.greatest(F.size("_r") - 1, F.lit(0))), lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), F.get(F.col("_r"), i + 1)["x"].alias("x2"), F.get(F.col("_r"), i + 1)["y"].alias("y2")))
    long = F.filter(ends, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    listed = rings.select("zone_id", "ring", long.alias("_e"))
    return listed.select("zone_id", "ring", F.size("_e").alias("edges"), F.posexplode("_e").alias("edge", "_p")).select(
        "zone_id", "ring", "edge", "edges", *[F.col(f"_p.{c}").alias(c) for c in POINTS])


def _side(a: str, b: str, px: str, py: str) -> Column:
    """On which side of edge ``a`` a point of edge ``b`` lies: 0 on its line."""
    e = lambda c: F.col(f"{a}_{c}")
    return F.signum((e("x2") - e("x1")) * (F.col(f"{b}_{py}") - e("y1")) - (e("y2") - e("y1")) * (F.col(f"{b}_{px}") - e("x1")))


def _in_box(a: str, b: str, px: str, py: str) -> Column:
    """Whether a point of edge ``b`` lies in the box of edge ``a``."""
    e = lambda c: F.col(f"{a}_{c}")
    return (F.col(f"{b}_{px}").between(F.least(e("x1"), e("x2")), F.greatest(e("x1"), e("x2")))
            & F.col(f"{b}_{py}").between(F.least(e("y1"), e("y2")), F.greatest(e("y1"), e("y2"))))


def _conflict() -> Column:
    """Whether edges a and b of one zone make it invalid.

    Edges of one ring may only meet where one follows the other, and then not fold back. Edges of different rings may
    touch in a point, but neither cross nor share a stretch. Either may come first in the zone, so that pairs need no
    turning before they are decided.
    """
    sides = [_side("a", "b", "x1", "y1"), _side("a", "b", "x2", "y2"), _side("b", "a", "x1", "y1"), _side("b", "a", "x2", "y2")]
    boxes = [_in_box("a", "b", "x1", "y1"), _in_box("a", "b", "x2", "y2"), _in_box("b", "a", "x1", "y1"), _in_box("b", "a", "x2", "y2")]
    crosses = (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0)
    touches = F.lit(False)
    for side, box in zip(sides, boxes):
        touches = touches | ((side == 0) & box)
    # Whether the later edge lies in line with the earlier one.
    in_line = F.when(_turned(), (sides[0] == 0) & (sides[1] == 0)).otherwise((sides[2] == 0) & (sides[3] == 0))

    def overlap(lo: str, hi: str) -> Column:
        ends = [(F.least(f"{e}_{lo}", f"{e}_{hi}"), F.greatest(f"{e}_{lo}", f"{e}_{hi}")) for e in "ab"]
        return F.least(ends[0][1], ends[1][1]) - F.greatest(ends[0][0], ends[1][0])

    shares = in_line & ((overlap("x1", "x2") > 0) | (overlap("y1", "y2") > 0))
    same = F.col("a_ring") == F.col("b_ring")
    low, high = F.least("a_edge", "b_edge"), F.greatest("a_edge", "b_edge")
    next_to = (high == low + 1) | ((low == 0) & (high == F.when(_turned(), F.col("a_edges")).otherwise(F.col("b_edges")) - 1))
    return F.when(~same, crosses | shares).when(next_to, shares).otherwise(crosses | touches)


def _turned() -> Column:
    """Whether edge a comes before edge b in the zone."""
    return (F.col("a_ring") < F.col("b_ring")) | ((F.col("a_ring") == F.col("b_ring")) & (F.col("a_edge") < F.col("b_edge")))


def meeting_edges(zones: DataFrame) -> DataFrame:
    """Pairs of edges (a_*, b_*, in either order) of a zone whose boxes meet; each pair once for every cell they share."""
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    # A small file of zones may be one partition, whose edges are many.
    edges = cut(ring_edges(spread(zones)).withColumn("grid", F.ceil(F.log2(extent)).cast("int")))
    grids = sorted(r[0] for r in edges.select("grid").distinct().collect())  # few: powers of two of edge lengths

    def cells(grid: Column, lo: str, hi: str) -> Column:
        size = F.pow(F.lit(2.0), grid)
        return F.sequence(F.floor(F.least(lo, hi) / size).cast("bigint"), F.floor(F.greatest(lo, hi) / size).cast("bigint"))

    def filed(df: DataFrame, grid: Column) -> DataFrame:
        return df.withColumn("cx", F.explode(cells(grid, "x1", "x2"))).withColumn("cy", F.explode(cells(grid, "y1", "y2")))

    names = ["ring", "edge", "edges", *POINTS, "grid"]
    own = filed(edges, F.col("grid")).select("zone_id", "cx", "cy", F.col("grid").alias("_grid"), *[F.col(c).alias(f"a_{c}") for c in names])
    coarser = F.filter(F.array(*[F.lit(g) for g in grids]), lambda g: g >= F.col("grid"))
    looking = filed(edges.withColumn("_grid", F.explode(coarser)), F.col("_grid")).select(
        "zone_id", "cx", "cy", "_grid", *[F.col(c).alias(f"b_{c}") for c in names])
    pair = own.join(shuffled(looking), ["zone_id", "_grid", "cx", "cy"])
    # Edges of one grid find each other twice.
    pair = pair.where((F.col("b_grid") < F.col("a_grid")) & ((F.col("a_ring") != F.col("b_ring")) | (F.col("a_edge") != F.col("b_edge"))) | (F.col("b_grid") == F.col("a_grid")) & _turned())
    span = lambda e, p, q: (F.least(f"{e}_{p}", f"{e}_{q}"), F.greatest(f"{e}_{p}", f"{e}_{q}"))
    meet = F.lit(True)
    for p, q in (("x1", "x2"), ("y1", "y2")):
        a, b = span("a", p, q), span("b", p, q)
        meet = meet & (a[0] <= b[1]) & (b[0] <= a[1])
    return pair.where(meet)


def _conflicts(a: dict, b: dict) -> np.ndarray:
    """:func:`_conflict` of pairs in Arrow, edge a before edge b in its zone."""
    side = lambda e, x, y: np.sign((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))
    low, high = (lambda e, c: np.minimum(e[f"{c}1"], e[f"{c}2"])), (lambda e, c: np.maximum(e[f"{c}1"], e[f"{c}2"]))
    boxed = lambda e, x, y: (x >= low(e, "x")) & (x <= high(e, "x")) & (y >= low(e, "y")) & (y <= high(e, "y"))
    ends = [(e, o[f"x{i}"], o[f"y{i}"]) for e, o in ((a, b), (b, a)) for i in (1, 2)]
    sides = [side(*end) for end in ends]
    crosses = (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0)
    touches = np.any([(s == 0) & boxed(*end) for s, end in zip(sides, ends)], axis=0)
    overlap = lambda c: np.minimum(high(a, c), high(b, c)) - np.maximum(low(a, c), low(b, c))
    shares = (sides[0] == 0) & (sides[1] == 0) & ((overlap("x") > 0) | (overlap("y") > 0))
    next_to = (b["edge"] == a["edge"] + 1) | ((a["edge"] == 0) & (b["edge"] == b["edges"] - 1))
    return np.where(a["ring"] != b["ring"], crosses | shares, np.where(next_to, shares, crosses | touches))


def _row_edges(rings: pa.ListArray) -> dict:
    """:func:`ring_edges` of zones in Arrow, with the place of the zone."""
    zone_of, ring_of, place, x, y = ring_points(rings)
    start = np.flatnonzero(place[1:] > 0)
    end = start + 1
    long = (x[start] != x[end]) | (y[start] != y[end])
    known = ~(np.isnan(x[start]) | np.isnan(y[start]) | np.isnan(x[end]) | np.isnan(y[end]))
    start, end = start[long & known], end[long & known]
    rows, firsts = ring_of[start], np.searchsorted(zone_of, zone_of)
    count = np.bincount(rows, minlength=len(zone_of))
    return {
        "zone": zone_of[rows], "ring": rows - firsts[rows], "edge": np.arange(len(rows)) - (np.cumsum(count) - count)[rows], "edges": count[rows],
        "x1": x[start], "y1": y[start], "x2": x[end], "y2": y[end]}


def _row_crossings(batches, most: int):
    """zone_id and FOUND of zones that are one row each; of one with more than ``most`` edges a row of -1."""
    names = ["zone_id", *[c.split()[0] for c in FOUND.split(", ")]]
    for batch in batches:
        e = _row_edges(batch.column("rings"))
        large = np.bincount(e["zone"], minlength=batch.num_rows) > most
        if large.any():
            marks = pa.array(np.full(int(large.sum()), -1, dtype="int32"))
            yield pa.RecordBatch.from_arrays([batch.column("zone_id").filter(pa.array(large)), *[marks] * 4], names=names)
            e = {k: v[~large[e["zone"]]] for k, v in e.items()}
        n = len(e["zone"])
        if not n:
            continue
        x_low, x_high = np.minimum(e["x1"], e["x2"]), np.maximum(e["x1"], e["x2"])
        order = np.lexsort((x_low, e["zone"]))
        e, x_low, x_high = {k: v[order] for k, v in e.items()}, x_low[order], x_high[order]
        y_low, y_high = np.minimum(e["y1"], e["y2"]), np.maximum(e["y1"], e["y2"])
        # The edges of its zone that begin at or before the end of an edge follow it; places by value make one sorted key of zone and x.
        values = np.unique(np.concatenate([x_low, x_high]), return_inverse=True)[1].reshape(2, -1)
        upto = np.searchsorted(e["zone"] * (2 * n) + values[0], e["zone"] * (2 * n) + values[1], side="right")
        met = upto - np.arange(n) - 1
        done, sums = 0, np.cumsum(met)
        while done < n:
            stop = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + PAIRS, side="right")))
            size = met[done:stop]
            i = np.repeat(np.arange(done, stop), size)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            both = (y_low[i] <= y_high[j]) & (y_low[j] <= y_high[i])
            i, j, done = i[both], j[both], stop
            turned = (e["ring"][j] < e["ring"][i]) | ((e["ring"][j] == e["ring"][i]) & (e["edge"][j] < e["edge"][i]))
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            bad = _conflicts(*({k: v[at] for k, v in e.items()} for at in (i, j)))
            i, j = i[bad], j[bad]
            if len(i):
                columns = [pa.array(e[k][at].astype("int32")) for at in (i, j) for k in ("ring", "edge")]
                yield pa.RecordBatch.from_arrays([batch.column("zone_id").take(pa.array(e["zone"][i])), *columns], names=names)


def crossings(zones: DataFrame) -> DataFrame:
    """(zone_id, a_ring, a_edge, b_ring, b_edge): pairs of edges that make a zone invalid."""
    # A row without an id is no zone, rows of one id are one.
    zones, most = zones.where(F.col("zone_id").isNotNull()).select("zone_id", "rings"), ROW_EDGES
    apart = cut(zones.groupBy("zone_id").count().where("count > 1").select("zone_id"))
    alone = zones if apart.isEmpty() else zones.join(small_side(apart), "zone_id", "left_anti")
    schema = T.StructType([zones.schema["zone_id"], *T._parse_datatype_string(FOUND).fields])
    alone = cut(alone.mapInArrow(lambda it: _row_crossings(it, most), schema))
    apart = apart.unionByName(alone.where("a_ring < 0").select("zone_id"))
    alone = alone.where("a_ring >= 0")
    if apart.isEmpty():
        return alone
    found = meeting_edges(zones.join(small_side(apart), "zone_id", "left_semi")).where(_conflict())
    first = lambda a, b, c: F.when(_turned(), F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{a}_{c}")
    return alone.unionByName(found.select("zone_id", *[first(*e, c) for e in ("ab", "ba") for c in ("ring", "edge")]).distinct())


def layer_problems(zones: DataFrame) -> DataFrame:
    """(zone_id, problem) of :func:`ring_problems` and ``crossing`` for zones whose edges conflict."""
    whole = zones.where(F.col("rings").isNotNull())
    return ring_problems(zones).unionByName(crossings(whole).select("zone_id", F.lit("crossing").alias("problem")).distinct())
