import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.functions import geodesy, keys, priors
from stratafold.operators import audit, draws, grids, polygons, rasters, splits


def box(spark, *boxes):
    return polygons.rectangles(spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "zone_id long, x1 double, y1 double, x2 double, y2 double"))


def test_quotas(spark):
    # Shares, totals and rows of published designs (fixed values).
    published = [((0.70, 0.05, 0.25), 20, (14, 1, 5)), ((0.50, 0.05, 0.45), 27121, (13560, 1356, 12205)), ((0.65, 0.05, 0.30), 27121, (17629, 1356, 8136))]
    for shares, total, rows in published:
        design = priors.DrawDesign(shares=dict(zip(priors.SHARES, shares)))
        got = spark.range(1).select(*[c.alias(n) for n, c in priors.quota_columns(F.lit(total), design).items()]).first()
        assert tuple(got) == rows and list(got.asDict()) == list(priors.SHARES)
    for wrong in ({"shares": {"hard": 0.9, "background": 0.25}}, {"begins": {"hard": 0.2, "transition": 0.5}}, {"cell": 0.0}, {"draws": 0}):
        with pytest.raises(ValueError):
            priors.DrawDesign(**wrong)


def test_strata(spark):
    rows = [(0.1, False, False, True), (0.3, False, False, True), (0.6, False, False, True), (0.1, True, False, True), (0.9, True, True, False)]
    data = spark.createDataFrame(rows, "s double, a boolean, b boolean, e boolean")
    got = [r[0] for r in data.select(priors.stratum(F.col("s"), F.col("a"), F.col("b"), F.col("e"), priors.DrawDesign())).collect()]
    assert got == ["background", "transition", "hard", "hard", "ineligible"]


def test_kernels(spark):
    data = spark.createDataFrame([(d,) for d in (0.0, 100.0, 500.0, 1000.0, 5000.0, None)], "d double")
    d = F.col("d")
    rows = data.select(
        priors.sampling_prior(d, "dome").alias("a"), priors.sampling_prior(d, "fault").alias("b"), priors.sampling_prior(d, "strata").alias("c"),
        priors.training_prior(d, "dome").alias("t"), priors.singularity_score(d, F.lit(100.0), F.lit(1000.0)).alias("s")).collect()
    for row, v in zip(rows, (0.0, 100.0, 500.0, 1000.0, 5000.0)):
        assert row["a"] == pytest.approx(math.exp(-v * v / 2e6)) and row["b"] == pytest.approx(math.exp(-0.002 * v))
        assert row["c"] == pytest.approx(math.exp(-v * v / (2 * 800 * 800))) and row["t"] == row["a"]
    assert rows[-1]["a"] is None and rows[-1]["t"] == 0.0 and rows[-1]["s"] == 0.0 and rows[0]["s"] == 1.0 and rows[3]["s"] == 0.0


def test_grid_and_strict_containment(spark):
    grid = grids.point_grid(spark, 100, 200, 161, 261, 20)
    assert grid.count() == 16
    inside = polygons.within(grid, box(spark, (100, 200, 161, 261)), "grid_ord").orderBy("grid_ord").collect()
    assert [(r["x"], r["y"]) for r in inside] == [(x, y) for x in (120.0, 140.0, 160.0) for y in (220.0, 240.0, 260.0)]
    found = grids.positive_candidates(grids.point_grid(spark, 0, 0, 61, 61, 20), box(spark, (20, 20, 60, 60)), box(spark, (0, 0, 61, 61))).collect()
    assert [(r["x"], r["y"], r["cand_id"]) for r in found] == [(40.0, 40.0, "C00000000")]


def test_positive_sample(spark):
    candidates = grids.number_rows(grids.point_grid(spark, 0, 0, 11, 11, 1), "grid_ord", "C%08d", "cand_id")
    assert candidates.count() == 121
    drawn = grids.positive_sample(candidates)
    assert drawn.count() == 12 and sorted(r[0] for r in drawn.select("sample_id").collect())[0] == "P0000000"
    kept = grids.positive_sample(candidates, box(spark, (0, 0, 5, 5)))
    assert kept.count() == drawn.where("not (x <= 5 and y <= 5)").count()
    with pytest.raises(ValueError):
        grids.positive_sample(candidates.limit(5))


@pytest.mark.parametrize("large", [False, True])
def test_shared_border_is_interior_to_the_union(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    layer = box(spark, (0, 0, 10, 10), (10, 0, 20, 10))
    points = spark.createDataFrame([(0, 10.0, 5.0), (1, 0.0, 5.0), (2, 5.0, 5.0), (3, 30.0, 5.0), (4, 20.0, 5.0)], "id long, x double, y double")
    rows = {r["id"]: (r["interior"], r["touches"]) for r in polygons.membership(points, layer, "id").collect()}
    assert rows == {0: (True, True), 1: (False, True), 2: (True, True), 4: (False, True)}
    assert sorted(r["id"] for r in polygons.outside(points, layer, "id").collect()) == [3]


@pytest.mark.parametrize("large", [False, True])
def test_general_polygons_against_brute_force(spark, large, request):
    if large:
        request.getfixturevalue("large_paths")
    rng = np.random.default_rng(5)
    shapes = []
    for z in range(12):
        angle = np.sort(rng.random(3 + 20 * z)) * 2 * math.pi
        radius = 20 + 80 * rng.random(len(angle))
        cx, cy = rng.random(2) * 2000
        ring = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a))) for a, r in zip(angle, radius)]
        shapes.append((z, [ring + ring[:1]]))
    layer = spark.createDataFrame(shapes, "zone_id long, rings array<array<struct<x:double,y:double>>>")
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)) * 2400 - 200)]
    table = spark.createDataFrame(points, "id long, x double, y double")
    inside, distance = {}, {}
    for i, px, py in points:
        gap, hit = math.inf, False
        for _, (ring,) in shapes:
            odd = False
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                    odd = not odd
                dx, dy = x2 - x1, y2 - y1
                t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                gap = min(gap, math.hypot(px - x1 - t * dx, py - y1 - t * dy))
            hit = hit or odd
        inside[i], distance[i] = hit, 0.0 if hit else gap
    got = {r["id"] for r in polygons.within(table, layer, "id").collect()}
    assert got == {i for i, v in inside.items() if v}
    for r in polygons.add_distance(table, layer, "id", "d").collect():
        assert r["d"] == pytest.approx(distance[r["id"]], abs=1e-6)
    hits = polygons.assign_zone(table, layer, "id").where("zone_id is not null").count()
    assert hits >= len(got)


def test_cell_and_block_ids(spark):
    xs = [(-0.5, -0.5), (0.0, 0.0), (170.0, -90.0)]
    got = [r[0] for r in spark.createDataFrame(xs, "x double, y double").select(keys.cell_id(F.col("x"), F.col("y"), 80.0)).collect()]
    want = [int(np.int64(math.floor(x / 80)) << np.int64(32) ^ np.int64(math.floor(y / 80) & 0xFFFFFFFF)) for x, y in xs]
    assert got == want
    pts = spark.createDataFrame([(0.0, 0.0), (9.9, 9.9), (5.1, 0.1)], "x double, y double")
    assert [r[0] for r in pts.select(keys.block_id(F.col("x"), F.col("y"), 2, 0.0, 0.0, 10.0, 10.0)).collect()] == [0, 3, 2]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(11.0, 0.0)], "x double, y double").select(keys.block_id(F.col("x"), F.col("y"), 2, 0.0, 0.0, 10.0, 10.0)).collect()


def pool(spark, n=600):
    rows = [(i, float(i % 40) * 30, float(i // 40) * 30, ("hard", "transition", "background")[i % 3]) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, x double, y double, stratum string").withColumn("block_id", keys.cell_id(F.col("x"), F.col("y"), 300.0))
    return draws.realizations(frame, 2, 80.0, (0.0, 0.0))


def test_staged_draw(spark):
    quotas = {"hard": 12, "transition": 3, "background": 6}
    chosen = draws.staged_draw(pool(spark), quotas, "id").collect()
    again = draws.staged_draw(pool(spark), quotas, "id").collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again))
    for realiz in (0, 1):
        mine = [r for r in chosen if r["realiz"] == realiz]
        assert len(mine) == 21 and len({r["thin_id"] for r in mine}) == 21
        assert {s: sum(r["stratum"] == s for r in mine) for s in quotas} == quotas
    assert {r["id"] for r in chosen if r["realiz"] == 0} != {r["id"] for r in chosen if r["realiz"] == 1}
    with pytest.raises(ValueError, match="too few transition"):
        draws.staged_draw(pool(spark), {**quotas, "transition": 10_000}, "id")


def test_draw_rotates_over_blocks(spark):
    rows = [(i, i, 0 if i < 90 else i - 89) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, thin_id long, block_id long").withColumn("realiz", F.lit(0)).withColumn("seed", F.lit(7).cast("bigint"))
    blocks = [r["block_id"] for r in draws.balanced_draw(frame, 11, "id", "t").collect()]
    assert sorted(blocks) == list(range(11))


def test_uniform_draw(spark):
    rows = [(i, i % 50, 0) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, thin_id long, block_id long").withColumn("realiz", F.lit(0)).withColumn("seed", F.lit(2026).cast("bigint"))
    one, two = (sorted(r["id"] for r in draws.uniform_draw(frame, 20, "id").collect()) for _ in range(2))
    assert one == two and len(one) == 20 and len({i % 50 for i in one}) == 20


def test_sample_checks(spark):
    rows = [("P1", 1, 0.0, 0.0, 0.0), ("N1", 0, 2000.0, 0.0, 999.999)]
    data = spark.createDataFrame(rows, "sample_id string, Class int, x double, y double, mine_dist double")
    got = {r["check"]: r["passed"] for r in audit.sample_checks(data, expected_positive=1, expected_negative=2, minimum_distance=1000.0).collect()}
    assert got == {"binary labels": True, "both classes": True, "unique ids": True, "unique coordinates": True, "positive count": True, "negative count": False, "minimum distance": False}
    with pytest.raises(ValueError):
        audit.sample_checks(data.drop("x"))


def test_utm_round_trip_and_series(spark):
    points = spark.createDataFrame([(500000.0, 7500000.0, True), (250000.0, 7450000.0, True), (620000.0, 5200000.0, False)], "x double, y double, s boolean")
    there = points.withColumn("p", geodesy.utm_to_lonlat(F.col("x"), F.col("y"), 33, F.col("s")))
    back = there.select("x", "y", "p", geodesy.lonlat_to_utm(F.col("p.lon"), F.col("p.lat"), 33, F.col("s")).alias("q")).collect()
    for r in back:
        assert r["q"]["x"] == pytest.approx(r["x"], abs=1e-4) and r["q"]["y"] == pytest.approx(r["y"], abs=1e-4)
    # Footpoint-latitude expansion of the published UTM formulas, an independent route.
    for r in there.collect():
        e2 = 0.08181919084262149**2
        m = (r["y"] - (1e7 if r["s"] else 0)) / 0.9996
        mu = m / (6378137 * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
        e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
        fp = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * math.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * math.sin(4 * mu) + 151 * e1**3 / 96 * math.sin(6 * mu)
        c, t, n = e2 / (1 - e2) * math.cos(fp)**2, math.tan(fp)**2, 6378137 / math.sqrt(1 - e2 * math.sin(fp)**2)
        d = (r["x"] - 500000) / (n * 0.9996)
        lon = 15 + math.degrees((d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * e2 / (1 - e2) + 24 * t * t) * d**5 / 120) / math.cos(fp))
        assert r["p"]["lon"] == pytest.approx(lon, abs=1e-7)


def test_crs_text_and_rings(spark):
    rows = spark.createDataFrame([("WGS 84 / UTM zone 33S",), ("UTM_Zone_7n",), ("ZONE 61S",), ("EPSG:4326",)], "t string").select(geodesy.utm_zone(F.col("t")).alias("z")).collect()
    assert [None if r["z"] is None else (r["z"]["zone"], r["z"]["south"]) for r in rows] == [(33, True), (7, False), None, None]


def test_raster_sampling(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, -9999.0), ("a", 1, 0, float("nan"))], "raster string, r int, c int, value double")
    meta = spark.sql("SELECT 'a' AS raster, 10D AS a, 0D AS b, 0D AS c0, 0D AS d, -10D AS e, 20D AS f0, 2L AS width, 2L AS height, -9999D AS nodata, 'x' AS crs")
    points = spark.createDataFrame([(1, 5.0, 15.0), (2, 15.0, 15.0), (3, 5.0, 5.0), (4, 25.0, 15.0)], "id long, x double, y double")
    got = {r["id"]: (r["inside"], r["value"]) for r in rasters.sample(points, pixels, meta, "id").collect()}
    assert got == {1: (True, 1.0), 2: (True, None), 3: (True, None), 4: (False, None)}
    assert rasters.summary(pixels, meta).first()["valid"] == 1


def test_split_problems(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 9)], "id long, label int, block_id long")
    blocks = spark.createDataFrame([(0, "train"), (1, "test"), (1, "train")], "block_id long, partition string")
    problems = {(r["problem"], r["detail"]) for r in splits.split_problems(splits.assign_partitions(rows, blocks), blocks).collect()}
    assert ("block in several partitions", "1") in problems and ("block without partition", "9") in problems and ("partition with one class", "test") in problems


def test_replacement_needs_one_sample_for_each_slot(spark):
    base = spark.createDataFrame([(i, i % 2, f"S{i}") for i in range(8)], "id long, label int, sample_id string")
    fresh = spark.createDataFrame([(0, p) for p in range(1, 5)], "label int, pick long")
    out = draws.replace_training_negatives(base, fresh, F.col("label") == 0, row_id="id")
    assert out.count() == 8 and out.where("sample_id LIKE 'NM%'").count() == 4
    for wrong in (fresh.where("pick < 4"), fresh.unionByName(fresh.where("pick = 1"))):
        with pytest.raises(ValueError):
            draws.replace_training_negatives(base, wrong, F.col("label") == 0, row_id="id")


def test_many_edged_zones_meet_a_bounded_number_of_bands(spark, large_paths):
    """Joined rows per point do not grow with the edges of a ring, and positions stay exact."""
    rng = np.random.default_rng(3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-120, 120, (400, 2)))]
    frame = spark.createDataFrame(points, "id long, x double, y double")
    met = []
    for n in (640, 6400):
        turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
        ring = [(100 * math.cos(t), 100 * math.sin(t)) for t in turn]
        ring.append(ring[0])
        zone = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], "zone_id long, rings array<array<struct<x:double,y:double>>>")
        filed = polygons.bands(zone)
        met.append(filed.groupBy("level_x", "level_y", "cx", "cy").count().agg(F.max("count")).first()[0])
        got = {r["id"] for r in polygons.membership(frame, zone, "id").where("interior").collect()}
        assert got == {i for i, x, y in points if math.hypot(x, y) < 100 * math.cos(math.pi / n)} | {
            i for i, x, y in points if 100 * math.cos(math.pi / n) <= math.hypot(x, y) < 100 and i in got}
    assert max(met) <= 9


def _rings(spark, rows):
    return spark.createDataFrame(rows, "zone_id long, rings array<array<struct<x:double,y:double>>>")


def test_layer_problems(spark):
    from stratafold.operators import topology
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    shifted = [(x + 2.5, y + 1.0) for x, y in hole]
    corner = [(x + 3.0, y + 3.0) for x, y in hole]
    rows = [
        (1, [square]), (2, [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]),  # a bow-tie
        (3, [[(0.0, 0.0), (4.0, 0.0), (6.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]),  # a spike
        (4, [square, hole]), (5, [square, shifted]), (6, [square, corner]),  # inside, crossing, touching in a point
        (7, [[(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]),  # a repeated vertex is no fault
        (8, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]),  # a vertex on another edge
        (9, None), (10, [square, [(4.0, 1.0), (6.0, 1.0), (6.0, 2.0), (4.0, 2.0), (4.0, 1.0)]])]  # empty; a shared stretch
    found = {(r["zone_id"], r["problem"]) for r in topology.layer_problems(_rings(spark, rows)).collect()}
    assert {z for z, p in found if p == "crossing"} == {2, 3, 5, 8, 10} and (9, "empty") in found


def test_long_ring_meets_only_neighbours(spark):
    """A ring of 20,000 edges beside one as long as itself: pairs stay in proportion to edges."""
    import math

    from stratafold.operators import topology
    n = 20_000
    ring = [(math.cos(2 * math.pi * i / n) * 1e4, math.sin(2 * math.pi * i / n) * 1e4) for i in range(n)]
    fan = [(0.0, 0.0), (9e3, 0.0), (9e3, 1.0), (0.0, 2.0), (0.0, 0.0)]
    zones = _rings(spark, [(1, [[*ring, ring[0]], fan])])
    assert n <= topology.meeting_edges(zones).count() < 2 * n
    assert topology.crossings(zones).count() == 0


def test_far_points_follow_few_cells(spark, large_paths, monkeypatch):
    """Distances to a ring of 4,000 edges from near and far; a cell of points holds a bounded number of cells a level."""
    import math

    from stratafold.operators import polygons
    n = 4_000
    ring = [(math.cos(2 * math.pi * i / n) * 1e3, math.sin(2 * math.pi * i / n) * 600) for i in range(n)]
    points = [(0, 0.0, 0.0), (1, 5e4, 0.0), (2, -5e4, 4e4), (3, 0.0, 601.0), (4, 990.0, 100.0)]
    sizes, cut = [], polygons.cut
    monkeypatch.setattr(polygons, "cut", lambda df: (lambda out: (sizes.append(out.count()) if set(out.columns) == {"fx", "fy", "cx", "cy"} else None, out)[1])(cut(df)))
    out = polygons.add_distance(spark.createDataFrame(points, "id long, x double, y double"), _rings(spark, [(1, [[*ring, ring[0]]])]), "id", "d")
    got = {r["id"]: r["d"] for r in out.collect()}

    def gap(x, y):
        best = math.inf
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
        return best

    for i, x, y in points:
        assert got[i] == (0.0 if i in (0,) or (x / 1e3) ** 2 + (y / 600) ** 2 < 0.99 else pytest.approx(gap(x, y), abs=1e-6))
    assert sizes and max(sizes) < 60 * len(points)


def test_metric_crs(spark):
    from stratafold.sources import vectors
    make = lambda crs, x: spark.createDataFrame([(1, [[(x, 1.0), (x + 1, 1.0), (x, 2.0), (x, 1.0)]], crs)], "zone_id long, rings array<array<struct<x:double,y:double>>>, crs string")
    for crs in ("EPSG:32733", "WGS 84 / UTM zone 33S"):
        vectors.require_metric_crs(make(crs, 500_000.0))
    for crs, x in (("EPSG:4326", 500_000.0), (None, 500_000.0), ("EPSG:32733", 13.0)):
        with pytest.raises(ValueError):
            vectors.require_metric_crs(make(crs, x))


def test_edges_meet_without_broadcast(spark):
    """Exploded edges of a small file are many: no side of their join is gathered whole, whatever the estimate says."""
    from stratafold.operators import topology
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    plan = topology.meeting_edges(_rings(spark, [(1, [square])]))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_large_lookup_side_is_never_broadcast(spark, large_paths):
    """Sides over the counted limit are shuffled, also when Spark's estimate (without exploded rows) is small."""
    from stratafold.operators.ordering import small_side
    points = spark.range(50).select(F.col("id"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    many = points.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    plans = [points.join(small_side(many), "id"), polygons.add_distance(points, box(spark, (0, 0, 5, 5), (20, 20, 30, 30)), "id", "d"),
             polygons.assign_zone(points, box(spark, (0, 0, 5, 5)), "id"), polygons.within(points, box(spark, (0, 0, 5, 5)), "id")]
    for plan in plans:
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_small_layer_meets_points_in_its_boxes_only(monkeypatch):
    """Zones are held against the points in their boxes, a block of pairs at a time; nothing else is tested, and nothing is lost."""
    rng = np.random.default_rng(5)
    corners = rng.integers(0, 40, (30, 2)).repeat(2, axis=1).reshape(30, 2, 2).transpose(0, 2, 1) + [[0, 0], [3, 2]]
    rings = [[{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))] for (a, b), (c, d) in corners]
    rings.append([{"x": float("nan"), "y": float("nan")}] * 5)  # a zone without coordinates: never hit, and no distance is known
    table, starts = np.concatenate([polygons._ring_edges(r) for r in rings]), np.arange(len(rings)) * 4
    xs, ys = (rng.choice([0.0, 0.25, 0.005, -0.005, 0.02], 3000) + rng.integers(-2, 46, 3000) for _ in range(2))
    xs[:3] = [np.nan, np.inf, -np.inf]
    pairs, hits = [], polygons._hits
    monkeypatch.setattr(polygons, "PAIRS", 100)
    monkeypatch.setattr(polygons, "_hits", lambda px, py, edges: pairs.append(len(px) * len(edges)) or hits(px, py, edges))
    for zones in (30, 31):
        pairs.clear()
        got = polygons._positions(xs, ys, table[:4 * zones], starts[:zones], np.arange(zones) + 7)
        low, high = corners[:, 0], corners[:, 1]
        gap = np.sqrt((np.maximum(0, np.maximum(low - (p := np.stack([xs, ys], 1)[:, None]), p - high)) ** 2).sum(axis=2))
        touch = (gap == 0).any(axis=1)
        near = np.where((gap <= polygons.ASSIGN_TOLERANCE).any(axis=1), (gap <= polygons.ASSIGN_TOLERANCE).argmax(axis=1) + 7, np.nan)
        assert (got["touches"] == touch).all() and 0 < touch.mean() < 0.9
        assert np.array_equal(got["zone_id"], near, equal_nan=True)
        assert (got["interior"] >= ((p > low) & (p < high)).all(axis=2).any(axis=1)).all() and not (got["interior"] & ~touch).any()
        if zones == 30:
            assert np.allclose(got["distance"][3:], gap[3:].min(axis=1)) and np.isnan(got["distance"][0])
            assert max(pairs) <= 100 and sum(pairs) < 0.05 * len(xs) * len(table)
        else:
            assert (got["distance"][touch] == 0).all() and np.isnan(got["distance"][~touch]).all()
    assert list(polygons._positions(xs, ys, table, starts, starts, ("interior",))) == ["interior"]


def test_used_cells_meet_one_row_a_cell(spark):
    """Cells taken by an earlier stratum go before blocks rotate; one row of a cell meets them, not all its candidates."""
    rows = [(i, 0, 7, None if i % 11 == 10 else i % 11, i % 3) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, realiz int, seed long, thin_id long, block_id long")
    used = spark.createDataFrame([(0, 1), (0, 4), (0, 5), (1, 6), (0, None)], "realiz int, thin_id long")
    drawn = draws.balanced_draw(frame, 100, "id", "t", used=used)
    free = draws.balanced_draw(frame.where("thin_id IS NULL OR thin_id NOT IN (1, 4, 5)"), 100, "id", "t")
    assert sorted(drawn.collect()) == sorted(free.collect()) and drawn.count() == 8
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate")  # printed from the top: the aggregate comes first


def test_sample_validation_makes_its_samples_once(spark):
    """The checks are passes over written samples: no step that makes them is left in their plan."""
    from stratafold.plans import spatial_plans
    plan = spatial_plans.sample_validation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "Union" not in plan and "Window" not in plan


def _squares_and_points(n_squares, n_points, span, seed):
    rng = np.random.default_rng(seed)
    corner, size = rng.random((n_squares, 2)) * span, rng.random(n_squares) * 12 + 4
    rows = [(z, [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]) for z, ((x, y), s) in enumerate(zip(corner.tolist(), size.tolist()))]
    points = [(i, x, y) for i, (x, y) in enumerate((rng.random((n_points, 2)) * span).tolist())]
    return rows, points


def _brute_distances(rows, points):
    from stratafold.operators import polygons
    table = [polygons._ring_edges([{"x": x, "y": y} for x, y in ring]) for _, rings in rows for ring in rings]
    starts = np.cumsum([0] + [sum(len(r) - 1 for r in rings) for _, rings in rows[:-1]])
    xs, ys = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    return polygons._positions(xs, ys, np.concatenate(table), starts, np.arange(len(rows)))["distance"]


def test_near_points_settle_in_their_tile(spark, large_paths, monkeypatch):
    """Distances to many small zones are written once a point, not once a cell and level."""
    from stratafold.operators import polygons
    rows, points = _squares_and_points(900, 1500, 1000.0, 3)
    written, cut = [], polygons.cut
    monkeypatch.setattr(polygons, "cut", lambda df: (lambda out: (written.append(out.count()), out)[1])(cut(df)))
    monkeypatch.setattr(polygons, "TILE_EDGES", 200)
    out = polygons.add_distance(spark.createDataFrame(points, "id long, x double, y double"), _rings(spark, rows), "id", "d")
    got = {r["id"]: r["d"] for r in out.collect()}
    assert np.allclose([got[i] for i, _, _ in points], _brute_distances(rows, points), atol=1e-9)
    assert sum(written) < 12_000


def test_distances_of_tiles_and_pyramid_agree(spark, large_paths, monkeypatch):
    """Small zones, one with a hole and one wider than a tile; near, far, crowded, repeated and unplaced points."""
    from stratafold.operators import polygons
    rows, points = _squares_and_points(60, 300, 400.0, 5)
    big = [(50.0, 60.0), (350.0, 40.0), (300.0, 200.0), (330.0, 380.0), (120.0, 300.0), (50.0, 60.0)]
    hole = [(500.0, 0.0), (520.0, 0.0), (520.0, 20.0), (500.0, 20.0), (500.0, 0.0)]
    rows += [(60, [big]), (61, [hole, [(505.0, 5.0), (505.0, 15.0), (515.0, 15.0), (515.0, 5.0), (505.0, 5.0)]])]
    corner = rows[0][1][0][0]
    points += [(300, 5e4, -3e4), (301, -900.0, 10.0), (302, 510.0, 10.0), (303, 502.0, 10.0), (304, *corner), (305, 200.0, 150.0)]
    crowd = [(400 + i, 390.0 + i / 50, 395.0) for i in range(40)]
    monkeypatch.setattr(polygons, "TILE_EDGES", 30)
    monkeypatch.setattr(polygons, "MOST_POINTS", 16)
    table = spark.createDataFrame([*points, *crowd, points[7], (None, 1.0, 1.0), (999, None, 1.0)], "id long, x double, y double")
    rows_of = polygons.add_distance(table, _rings(spark, rows), "id", "d").collect()
    got = {r["id"]: r["d"] for r in rows_of}
    assert len(rows_of) == len(points) + len(crowd) + 3 and got[None] is None and got[999] is None
    assert np.allclose([got[p[0]] for p in points + crowd], _brute_distances(rows, points + crowd), atol=1e-9)
    monkeypatch.setattr(polygons, "MOST_EDGES", 0)  # every tile is too full: the pyramid alone
    alone = {r["id"]: r["d"] for r in polygons.add_distance(table, _rings(spark, rows), "id", "d").collect()}
    assert all(alone[i] == pytest.approx(d, abs=1e-9) for i, d in got.items() if d is not None) and 0.0 in alone.values()


def test_zones_are_decided_inside_their_rows(spark, monkeypatch):
    """Crossings of zones in one row each need no join of edges and agree with it; rows of one id are one zone."""
    from stratafold.operators import topology
    rng = np.random.default_rng(8)
    rows = []
    for z in range(60):
        rings = []
        for _ in range(1 + z % 3):
            p = rng.integers(0, 9, (rng.integers(0, 9), 2)).astype(float).tolist()
            rings.append([tuple(q) for q in [*p, *p[:1]]])
        rows.append((z, rings))
    rows[7] = (7, [[(0.0, 0.0), (4.0, None), (4.0, 4.0), (0.0, 0.0)], rows[7][1][0]])
    rows += [(100, None), (None, rows[5][1]), (101, [])]
    zones = _rings(spark, rows)
    names = ("zone_id", "a_ring", "a_edge", "b_ring", "b_edge")
    listed = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
    joined = []
    meeting = topology.meeting_edges
    monkeypatch.setattr(topology, "meeting_edges", lambda df: joined.append(df.count()) or meeting(df))
    got = listed(topology.crossings(zones))
    assert not joined and len(got) > 60 and len(set(got)) == len(got)
    monkeypatch.setattr(topology, "ROW_EDGES", 0)
    assert listed(topology.crossings(zones)) == got and joined and joined[0] > 40
    split = _rings(spark, [*rows, rows[3], (9, rows[10][1])])  # one zone twice, one in two parts
    monkeypatch.undo()
    again, whole = listed(topology.crossings(split)), {r for r in got if r[0] != 9}
    assert whole <= set(again) and {r for r in again if r[0] != 9} == whole and len(set(again)) == len(again)
