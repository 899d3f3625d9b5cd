"""Raster, polygon, prior and sampling queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafold.functions import geodesy, keys, priors, text
from stratafold.operators import audit, draws, grids, polygons, rasters, topology
from stratafold.plans.metric_plans import r6
from stratafold.plans.views import view, with_views
from stratafold.session import cut, spread

PLANS: dict = {}
SEED = 2026
NAMES = ["acct", "price"]
# Zones 0-7 are known deposits, 8-15 structures, 16-24 lithology in the fixture.
GROUPS = {"mine": (0, 7), "structure": (8, 15), "lithology": (16, 24)}
THIN, BLOCK, REALIZATIONS = 250.0, 2000.0, 10
DESIGN = priors.DrawDesign(cell=THIN, block=BLOCK, draws=REALIZATIONS)


def plan(name: str, sql: str | None = None):
    def add(fn):
        PLANS[name] = (fn, sql)
        return fn
    return add


def raster_meta(spark):
    rows = ", ".join(
        f"('{n}', 500D, 0D, 0D, 0D, -500D, 20000D, 40L, {1 << 40}L, -9999D, 'WGS 84 / UTM zone 33S')" for n in NAMES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(raster, a, b, c0, d, e, f0, width, height, nodata, crs)")


def zones(spark, folder, group=None):
    rects = view(spark, folder, "v_zone")
    if group:
        rects = rects.where(F.col("zone_id").between(*GROUPS[group]))
    return polygons.rectangles(rects)


SAMPLED = """+ps AS (SELECT p.id, n.raster, CAST(floor((20000 - p.y) / 500) AS BIGINT) AS r, CAST(floor(p.x / 500) AS BIGINT) AS c
 FROM v_point p, (VALUES ('acct'), ('price')) AS n(raster)),
 sv AS (SELECT ps.id, ps.raster, ps.r, ps.c, (ps.r >= 0 AND ps.c BETWEEN 0 AND 39) AS inside, CASE WHEN value <> -9999.0 AND ps.r >= 0 AND ps.c BETWEEN 0 AND 39 THEN value END AS value
 FROM ps LEFT JOIN v_pixel q ON q.raster = ps.raster AND q.r = ps.r AND q.c = ps.c)"""


@plan("point_raster_sample", with_views(SAMPLED + " SELECT id, raster, r, c, inside, round(value, 6) AS value FROM sv", "v_point", "v_pixel"))
def point_raster_sample(spark, folder):
    out = rasters.sample(view(spark, folder, "v_point"), view(spark, folder, "v_pixel"), raster_meta(spark), "id")
    return out.select("id", "raster", "r", "c", "inside", *r6("value"))


MATRIX = SAMPLED + """, fm AS (SELECT id, max(CASE WHEN raster = 'acct' THEN value END) AS acct, max(CASE WHEN raster = 'price' THEN value END) AS price FROM sv GROUP BY id)"""


def matrix(spark, folder):
    return rasters.feature_matrix(view(spark, folder, "v_point"), view(spark, folder, "v_pixel"), raster_meta(spark), "id", NAMES)


@plan("feature_matrix", with_views(MATRIX + " SELECT id, round(acct, 6) AS acct, round(price, 6) AS price FROM fm", "v_point", "v_pixel"))
def feature_matrix(spark, folder):
    return matrix(spark, folder).select("id", *r6(*NAMES))


@plan("coverage_mask", with_views(MATRIX + " SELECT id, (acct IS NOT NULL AND price IS NOT NULL) AS covered FROM fm", "v_point", "v_pixel"))
def coverage_mask(spark, folder):
    return rasters.covered(matrix(spark, folder), NAMES).select("id", "covered")


@plan("zone_flags", with_views("""+z AS (SELECT p.id, bool_or(x > x1 AND x < x2 AND y > y1 AND y < y2) AS interior, bool_or(x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2) AS touches FROM v_point p, v_zone GROUP BY p.id)
 SELECT id, interior, touches FROM z WHERE touches""", "v_point", "v_zone"))
def zone_flags(spark, folder):
    return polygons.membership(view(spark, folder, "v_point"), zones(spark, folder), "id")


GAP = "sqrt(pow(greatest(x1 - x, x - x2, 0), 2) + pow(greatest(y1 - y, y - y2, 0), 2))"


@plan("zone_distance", with_views(f"+z AS (SELECT id, min({GAP}) AS d FROM v_point, v_zone GROUP BY id) SELECT id, round(d, 6) AS distance FROM z", "v_point", "v_zone"))
def zone_distance(spark, folder):
    return polygons.add_distance(view(spark, folder, "v_point"), zones(spark, folder), "id", "distance").select("id", *r6("distance"))


@plan("parcel_distance", with_views(f"+z AS (SELECT id, min({GAP}) AS d FROM v_point, v_parcel GROUP BY id) SELECT id, round(d, 6) AS distance FROM z", "v_point", "v_parcel"))
def parcel_distance(spark, folder):
    """Distances to a layer that grows with the data."""
    parcels = polygons.rectangles(view(spark, folder, "v_parcel"))
    return polygons.add_distance(view(spark, folder, "v_point"), parcels, "id", "distance").select("id", *r6("distance"))


# Corners of a convex ring, scaled per zone and corner; every eleventh zone has two of them exchanged, every seventeenth folds back.
CORNERS = [(10, 0), (9, 5), (5, 9), (0, 10), (-5, 9), (-9, 5), (-10, 0), (-9, -5), (-5, -9), (0, -10), (5, -9), (9, -5)]
SIDES = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(CORNERS))
RING_POINTS = f"""+vt AS (SELECT id AS zone_id, k, x + cx * f AS x, y + cy * f AS y FROM (SELECT id, x, y, k, 3 + (id * c) % 4 AS f, cx, cy FROM v_point,
   (SELECT p AS k, c, cx, cy FROM range(12) AS r(p), (VALUES {SIDES}) AS v(c, cx, cy)) AS s
   WHERE c = CASE WHEN id % 11 = 0 AND k = 3 THEN 8 WHEN id % 11 = 0 AND k = 8 THEN 3 WHEN id % 17 = 0 AND k = 6 THEN 4 ELSE k END)),
 ed AS (SELECT a.zone_id, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vt a JOIN vt b ON a.zone_id = b.zone_id AND b.k = (a.k + 1) % 12),
 pr AS (SELECT a.zone_id, a.k AS a_edge, b.k AS b_edge, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
   FROM ed a JOIN ed b ON a.zone_id = b.zone_id AND a.k < b.k),
 sd AS (SELECT *, sign((ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1)) AS s1, sign((ax2 - ax1) * (by2 - ay1) - (ay2 - ay1) * (bx2 - ax1)) AS s2,
   sign((bx2 - bx1) * (ay1 - by1) - (by2 - by1) * (ax1 - bx1)) AS s3, sign((bx2 - bx1) * (ay2 - by1) - (by2 - by1) * (ax2 - bx1)) AS s4 FROM pr)
 SELECT zone_id, CAST(a_edge AS INT) AS a_edge, CAST(b_edge AS INT) AS b_edge FROM sd WHERE CASE WHEN b_edge = a_edge + 1 OR (a_edge = 0 AND b_edge = 11)
   THEN s1 = 0 AND s2 = 0 AND (least(greatest(ax1, ax2), greatest(bx1, bx2)) > greatest(least(ax1, ax2), least(bx1, bx2)) OR least(greatest(ay1, ay2), greatest(by1, by2)) > greatest(least(ay1, ay2), least(by1, by2)))
   ELSE (s1 * s2 < 0 AND s3 * s4 < 0)
     OR (s1 = 0 AND bx1 BETWEEN least(ax1, ax2) AND greatest(ax1, ax2) AND by1 BETWEEN least(ay1, ay2) AND greatest(ay1, ay2))
     OR (s2 = 0 AND bx2 BETWEEN least(ax1, ax2) AND greatest(ax1, ax2) AND by2 BETWEEN least(ay1, ay2) AND greatest(ay1, ay2))
     OR (s3 = 0 AND ax1 BETWEEN least(bx1, bx2) AND greatest(bx1, bx2) AND ay1 BETWEEN least(by1, by2) AND greatest(by1, by2))
     OR (s4 = 0 AND ax2 BETWEEN least(bx1, bx2) AND greatest(bx1, bx2) AND ay2 BETWEEN least(by1, by2) AND greatest(by1, by2)) END"""


def point_rings(spark, folder):
    """A twelve-cornered ring around every point, some of them spoilt."""
    listed = F.array(*[F.struct(F.lit(float(x)).alias("cx"), F.lit(float(y)).alias("cy")) for x, y in CORNERS])

    def corner(k):
        c = (F.when((F.col("id") % 11 == 0) & (k == 3), 8).when((F.col("id") % 11 == 0) & (k == 8), 3)
             .when((F.col("id") % 17 == 0) & (k == 6), 4).otherwise(k))
        size = 3 + (F.col("id") * c) % 4
        return F.struct((F.col("x") + F.get(listed, c)["cx"] * size).alias("x"), (F.col("y") + F.get(listed, c)["cy"] * size).alias("y"))

    places = F.array(*[F.lit(k) for k in (*range(12), 0)])
    return spread(view(spark, folder, "v_point")).select(F.col("id").alias("zone_id"), F.array(F.transform(places, corner)).alias("rings"))


@plan("ring_crossings", with_views(RING_POINTS, "v_point"))
def ring_crossings(spark, folder):
    """Edges that make the rings around points invalid."""
    return topology.crossings(point_rings(spark, folder)).select("zone_id", "a_edge", "b_edge")


@plan("zone_assign", with_views(f"+z AS (SELECT id, min(CASE WHEN {GAP} <= 0.01 THEN zone_id END) AS zone_id FROM v_point, v_zone GROUP BY id) SELECT id, zone_id FROM z WHERE zone_id IS NOT NULL", "v_point", "v_zone"))
def zone_assign(spark, folder):
    return polygons.assign_zone(view(spark, folder, "v_point"), zones(spark, folder), "id").where("zone_id is not null").select("id", "zone_id")


POOL = MATRIX + f""", zd AS (SELECT id, min(CASE WHEN zone_id <= 7 THEN {GAP} END) AS mine_dist, min({GAP}) AS zone_dist,
 bool_or(zone_id BETWEEN 8 AND 15 AND x > x1 AND x < x2 AND y > y1 AND y < y2) AS in_struct,
 bool_or(zone_id >= 16 AND x > x1 AND x < x2 AND y > y1 AND y < y2) AS in_lith FROM v_point, v_zone GROUP BY id),
 pr AS (SELECT p.id, p.x, p.y, acct, price, mine_dist, in_struct, in_lith, exp(-(acct * acct) / 2000000.0) AS p_dome, exp(-0.002 * price) AS p_fault, exp(-(zone_dist * zone_dist) / 1280000.0) AS p_strata
 FROM v_point p JOIN fm USING (id) JOIN zd USING (id)),
 gs AS (SELECT *, greatest(p_dome, p_fault, p_strata) AS geo_score, (acct IS NOT NULL AND price IS NOT NULL AND mine_dist >= 1000) AS eligible FROM pr),
 st AS (SELECT *, CASE WHEN NOT eligible THEN 'ineligible' WHEN in_struct OR in_lith OR geo_score >= 0.5 THEN 'hard' WHEN geo_score >= 0.2 THEN 'transition' ELSE 'background' END AS stratum FROM gs)"""
POOL_VIEWS = ("v_point", "v_pixel", "v_zone")


def candidate_pool(spark, folder, known=None):
    """Points with priors, zone flags, distances and strata, and with ``known`` the zone_id in that layer."""
    points = matrix(spark, folder).select("id", "x", "y", *NAMES)
    if known is not None:
        points = polygons.assign_zone(points, known, "id")
    points = polygons.flag(points, zones(spark, folder, "structure"), "id", "in_struct")
    points = polygons.flag(points, zones(spark, folder, "lithology"), "id", "in_lith")
    points = polygons.add_distance(points, zones(spark, folder, "mine"), "id", "mine_dist")
    points = polygons.add_distance(points, zones(spark, folder), "id", "zone_dist")
    scored = points.select(
        "*", priors.sampling_prior(F.col("acct"), "dome").alias("p_dome"), priors.sampling_prior(F.col("price"), "fault").alias("p_fault"),
        priors.sampling_prior(F.col("zone_dist"), "strata").alias("p_strata"))
    scored = rasters.covered(scored, NAMES).withColumn("geo_score", priors.strongest(F.col("p_dome"), F.col("p_fault"), F.col("p_strata")))
    eligible = F.col("covered") & F.col("geo_score").isNotNull() & (F.col("mine_dist") >= DESIGN.gap)
    return scored.withColumn("eligible", eligible).withColumn(
        "stratum", priors.stratum(F.col("geo_score"), F.col("in_struct"), F.col("in_lith"), F.col("eligible"), DESIGN))


@plan("prior_scores", with_views(POOL + """ SELECT id, round(p_dome, 6) AS p_dome, round(p_fault, 6) AS p_fault, round(p_strata, 6) AS p_strata, round(geo_score, 6) AS geo_score, round(coalesce(p_dome, 0), 6) AS t_dome FROM st""", *POOL_VIEWS))
def prior_scores(spark, folder):
    pool = candidate_pool(spark, folder).withColumn("t_dome", priors.training_prior(F.col("acct"), "dome"))
    return pool.select("id", *r6("p_dome", "p_fault", "p_strata", "geo_score", "t_dome"))


@plan("training_kernels", with_views("""+v AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE x / 10 END AS d FROM v_point), q AS (SELECT min(d) AS lo, max(d) AS hi FROM v WHERE id % 2 = 0)
 SELECT id, round(coalesce(exp(-d * d / (2 * 1000.0 * 1000.0)), 0), 6) AS dome, round(coalesce(exp(-0.002 * d), 0), 6) AS fault, round(coalesce(exp(-d * d / (2 * 800.0 * 800.0)), 0), 6) AS strata,
 round(CASE WHEN d IS NULL THEN 0 ELSE 1 - (greatest(lo, least(hi, d)) - lo) / (hi - lo) END, 6) AS singular, round(1 / (1 + exp(-(coalesce(d, 0) - 1000) / 100)), 6) AS logit FROM v, q""", "v_point"))
def training_kernels(spark, folder):
    """All training kernels of a distance that is sometimes missing, its singularity score, and a logistic score."""
    rows = view(spark, folder, "v_point").select("id", F.when(F.col("id") % 7 != 0, F.col("x") / 10).alias("d"))
    bounds = rows.where("id % 2 = 0").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    scored = rows.join(F.broadcast(bounds)).select(  # one row
        "id", *[priors.training_prior(F.col("d"), k).alias(k) for k in ("dome", "fault", "strata")],
        priors.singularity_score(F.col("d"), F.col("lo"), F.col("hi")).alias("singular"), text.logistic((F.coalesce("d", F.lit(0.0)) - 1000) / 100).alias("logit"))
    return scored.select("id", *r6("dome", "fault", "strata", "singular", "logit"))


@plan("geo_strata", with_views(POOL + " SELECT id, in_struct, in_lith, round(mine_dist, 6) AS mine_dist, eligible, stratum FROM st", *POOL_VIEWS))
def geo_strata(spark, folder):
    return candidate_pool(spark, folder).select("id", "in_struct", "in_lith", *r6("mine_dist"), "eligible", "stratum")


HALF_EVEN = "CASE WHEN abs({v} - floor({v}) - 0.5) < 1e-9 THEN 2 * round(floor({v}) / 2.0 + 0.25) ELSE round({v}) END"


@plan("stratum_quotas", with_views(f"""+t AS (SELECT realiz, count(*) AS total FROM v_point GROUP BY realiz),
 q AS (SELECT realiz, total, CAST({HALF_EVEN.format(v='(total * CAST(0.7 AS DOUBLE))')} AS BIGINT) AS hard, CAST({HALF_EVEN.format(v='(total * CAST(0.05 AS DOUBLE))')} AS BIGINT) AS transition FROM t)
 SELECT realiz, total, hard, transition, total - hard - transition AS background FROM q""", "v_point"))
def stratum_quotas(spark, folder):
    totals = view(spark, folder, "v_point").groupBy("realiz").agg(F.count("*").alias("total"))
    return totals.select("realiz", "total", *[c.alias(n) for n, c in priors.quota_columns(F.col("total"), DESIGN).items()])


def hex52(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE)"


def cell_sql(x: str, y: str, size: float) -> str:
    ix, iy = f"CAST(floor(({x}) / {size}::DOUBLE) AS BIGINT)", f"CAST(floor(({y}) / {size}::DOUBLE) AS BIGINT)"
    return f"({ix} * 4294967296 + (({iy} % 4294967296) + 4294967296) % 4294967296)"


# Origin of both grids is the minimum over all points.
DRAW = POOL + f""", og AS (SELECT min(x) AS ox, min(y) AS oy FROM v_point),
 rz AS (SELECT CAST(i AS INT) AS realiz, 2025 + 1009 * i AS seed FROM range({REALIZATIONS}) AS t(i)),
 off AS (SELECT realiz, seed, {hex52("seed || '|offset_x'")} * {THIN} AS dx, {hex52("seed || '|offset_y'")} * {THIN} AS dy FROM rz),
 cand AS (SELECT st.*, realiz, seed, {cell_sql('x - ox + dx', 'y - oy + dy', THIN)} AS thin_id, {cell_sql('x - ox', 'y - oy', BLOCK)} AS block_id FROM st, off, og WHERE eligible)"""


def stage_sql(name: str, quota: str, earlier: list[str]) -> str:
    p = name[0]
    gone = " UNION ALL ".join(f"SELECT realiz, thin_id FROM {e[0]}_sel" for e in earlier)
    free = f"AND NOT EXISTS (SELECT 1 FROM ({gone}) u WHERE u.realiz = c.realiz AND u.thin_id = c.thin_id)" if earlier else ""
    return f""", {p}_rep AS (SELECT *, row_number() OVER (PARTITION BY realiz, thin_id ORDER BY md5(seed || '|{name}-cell|' || id), id) AS rn FROM cand c WHERE stratum = '{name}' {free}),
 {p}_rnd AS (SELECT *, row_number() OVER (PARTITION BY realiz, block_id ORDER BY md5(seed || '|{name}-perm|' || id), id) AS rd FROM {p}_rep WHERE rn = 1),
 {p}_pick AS (SELECT *, row_number() OVER (PARTITION BY realiz ORDER BY rd, md5(seed || '|{name}-block|' || block_id), id) AS pick FROM {p}_rnd),
 {p}_sel AS (SELECT id, realiz, stratum, thin_id, block_id, pick FROM {p}_pick, qt WHERE pick <= {quota})"""


QUOTAS = """, tot AS (SELECT greatest(1, count(*) // 20) AS t FROM st WHERE eligible), qt AS (SELECT CAST(round_even(t * CAST(0.7 AS DOUBLE), 0) AS BIGINT) AS qh, CAST(round_even(t * CAST(0.05 AS DOUBLE), 0) AS BIGINT) AS qtr, t FROM tot)"""
STAGED = (DRAW + QUOTAS + stage_sql("transition", "qtr", []) + stage_sql("background", "(t - qh - qtr)", ["transition"])
          + stage_sql("hard", "qh", ["transition", "background"])
          + ", sel AS (SELECT * FROM t_sel UNION ALL SELECT * FROM b_sel UNION ALL SELECT * FROM h_sel)")


def eligible_pool(spark, folder):
    """Eligible candidates, written once: every later stage reads them."""
    pool = cut(candidate_pool(spark, folder).where("eligible"))
    origin = view(spark, folder, "v_point").agg(F.min("x"), F.min("y")).first()
    blocks = pool.withColumn("block_id", keys.cell_id(F.col("x"), F.col("y"), BLOCK, origin[0], origin[1]))
    return blocks, draws.realizations(blocks, REALIZATIONS, THIN, origin)


def fixture_quotas(pool):
    total = F.lit(max(1, pool.count() // 20))
    return pool.sparkSession.range(1).select(*[c.alias(n) for n, c in priors.quota_columns(total, DESIGN).items()]).first().asDict()


@plan("spatial_cells", with_views(DRAW + " SELECT id, realiz, thin_id, block_id FROM cand", *POOL_VIEWS))
def spatial_cells(spark, folder):
    return eligible_pool(spark, folder)[1].select("id", "realiz", "thin_id", "block_id")


@plan("stratum_capacity", with_views(DRAW + QUOTAS + """ SELECT realiz, stratum, count(*) AS points, count(DISTINCT thin_id) AS thin_cells,
 max(CASE stratum WHEN 'hard' THEN qh WHEN 'transition' THEN qtr ELSE t - qh - qtr END) AS quota,
 count(DISTINCT thin_id) >= max(CASE stratum WHEN 'hard' THEN qh WHEN 'transition' THEN qtr ELSE t - qh - qtr END) AS feasible FROM cand, qt GROUP BY realiz, stratum""", *POOL_VIEWS))
def stratum_capacity(spark, folder):
    pool, spread = eligible_pool(spark, folder)
    return draws.capacity(spread, fixture_quotas(pool))


@plan("thin_cells", with_views(DRAW + """ SELECT realiz, thin_id, arg_min(id, md5(seed || '|any-cell|' || id)) AS id FROM cand GROUP BY realiz, thin_id""", *POOL_VIEWS))
def thin_cells(spark, folder):
    return draws.representatives(eligible_pool(spark, folder)[1], "id", "any").select("realiz", "thin_id", "id")


@plan("balanced_draw", with_views(STAGED + " SELECT id, realiz, stratum, thin_id, block_id, pick FROM sel", *POOL_VIEWS))
def balanced_draw(spark, folder):
    pool, spread = eligible_pool(spark, folder)
    return draws.staged_draw(spread, fixture_quotas(pool), "id", strict=False).select("id", "realiz", "stratum", "thin_id", "block_id", "pick")


@plan("uniform_cell_draw", with_views(DRAW + QUOTAS + """, u_rep AS (SELECT *, row_number() OVER (PARTITION BY realiz, thin_id ORDER BY md5(seed || '|uniform-cell|' || id), id) AS rn FROM cand),
 u_pick AS (SELECT *, row_number() OVER (PARTITION BY realiz ORDER BY md5(seed || '|uniform|' || id), id) AS pick FROM u_rep WHERE rn = 1)
 SELECT id, realiz, thin_id, block_id, pick FROM u_pick, qt WHERE pick <= t""", *POOL_VIEWS))
def uniform_cell_draw(spark, folder):
    pool, spread = eligible_pool(spark, folder)
    return draws.uniform_draw(spread, sum(fixture_quotas(pool).values()), "id").select("id", "realiz", "thin_id", "block_id", "pick")


SAMPLES = STAGED + f""", pos0 AS (SELECT p.id, p.x, p.y, min(CASE WHEN {GAP} <= 0.01 THEN zone_id END) AS zone_id FROM v_point p, v_zone WHERE zone_id <= 7 GROUP BY p.id, p.x, p.y),
 pos AS (SELECT id, x, y, zone_id, row_number() OVER (ORDER BY id) - 1 AS k FROM pos0 WHERE zone_id IS NOT NULL),
 smp AS (SELECT printf('P%07d', k) AS sample_id, 1 AS Class, 'known' AS stratum, zone_id, realiz, CAST(-1 AS BIGINT) AS block_id, CAST(-1 AS BIGINT) AS thin_id, pos.x, pos.y, geo_score, CAST(0 AS DOUBLE) AS mine_dist FROM pos JOIN st USING (id), rz
 UNION ALL SELECT printf('N%02d', realiz) || CASE sel.stratum WHEN 'hard' THEN 'H' WHEN 'transition' THEN 'T' ELSE 'B' END || printf('%06d', pick - 1), 0, sel.stratum, -1, realiz, block_id, thin_id, x, y, geo_score, mine_dist FROM sel JOIN st USING (id))"""


def combined_samples(spark, folder):
    """Known positives and pseudo-absences of every realization in one table."""
    base = cut(candidate_pool(spark, folder, zones(spark, folder, "mine")))
    pos = base.select("id", "x", "y", "geo_score", "zone_id").where("zone_id is not null")
    pos = grids.number_rows(pos, "id", "P%07d", "sample_id")
    origin = base.agg(F.min("x"), F.min("y")).first()
    pool = base.where("eligible").withColumn("block_id", keys.cell_id(F.col("x"), F.col("y"), BLOCK, origin[0], origin[1]))
    spread = draws.realizations(pool, REALIZATIONS, THIN, origin)
    chosen = draws.negative_ids(draws.staged_draw(spread, fixture_quotas(pool), "id", strict=False))
    attributes = base.select("id", "x", "y", "geo_score", "mine_dist")
    fields = ["sample_id", "Class", "stratum", "zone_id", "realiz", "block_id", "thin_id", "x", "y", "geo_score", "mine_dist"]
    negatives = chosen.join(attributes, "id").select("*", F.lit(0).alias("Class"), F.lit(-1).alias("zone_id")).select(*fields)
    unset = F.lit(-1).cast("bigint")
    positives = pos.select(
        "*", F.lit(1).alias("Class"), F.lit("known").alias("stratum"), unset.alias("block_id"), unset.alias("thin_id"), F.lit(0.0).alias("mine_dist"),
        F.explode(F.array(*[F.lit(i) for i in range(REALIZATIONS)])).alias("realiz")).select(*fields)
    return positives.unionByName(negatives)


@plan("pseudo_absences", with_views(SAMPLES + """ SELECT sample_id, Class, stratum, zone_id, realiz, block_id, thin_id, x, y, round(geo_score, 6) AS geo_score, round(mine_dist, 6) AS mine_dist FROM smp""", *POOL_VIEWS))
def pseudo_absences(spark, folder):
    out = combined_samples(spark, folder)
    return out.withColumn("geo_score", F.round("geo_score", 6)).withColumn("mine_dist", F.round("mine_dist", 6))


@plan("sample_validation", with_views(SAMPLES + """, g AS (SELECT realiz, count(*) AS n, sum(Class) AS pos, count(*) - sum(Class) AS neg, count(*) - count(DISTINCT sample_id) AS dup_id, count(*) - count(DISTINCT x || '|' || y) AS dup_xy,
 count(*) FILTER (Class = 0) - count(DISTINCT CASE WHEN Class = 0 THEN thin_id END) AS dup_thin, min(CASE WHEN Class = 0 THEN mine_dist END) AS near FROM smp GROUP BY realiz)
 SELECT realiz, 'binary labels' AS check, true AS passed, CAST(0 AS DOUBLE) AS observed FROM g
 UNION ALL SELECT realiz, 'both classes', pos > 0 AND neg > 0, CAST(least(pos, neg) AS DOUBLE) FROM g
 UNION ALL SELECT realiz, 'unique ids', dup_id = 0, dup_id FROM g UNION ALL SELECT realiz, 'unique coordinates', dup_xy = 0, dup_xy FROM g
 UNION ALL SELECT realiz, 'unique thinning cells', dup_thin = 0, dup_thin FROM g
 UNION ALL SELECT realiz, 'minimum distance', coalesce(near >= 999.999999, true), round(near, 6) FROM g""", *POOL_VIEWS))
def sample_validation(spark, folder):
    # Written once: each check is a pass over the samples.
    out = audit.sample_checks(cut(combined_samples(spark, folder)), ["realiz"], minimum_distance=DESIGN.gap)
    return out.select("realiz", "check", "passed", *r6("observed"))


@plan("realization_summary", with_views(SAMPLES + """ SELECT realiz, CAST(sum(Class) AS BIGINT) AS positive, count(*) FILTER (Class = 0) AS negative, count(*) FILTER (stratum = 'hard') AS hard, count(*) FILTER (stratum = 'transition') AS transition,
 count(*) FILTER (stratum = 'background') AS background, count(DISTINCT CASE WHEN Class = 0 THEN block_id END) AS unique_blocks, count(DISTINCT CASE WHEN Class = 0 THEN thin_id END) AS unique_thin_cells,
 round(min(CASE WHEN Class = 0 THEN mine_dist END), 6) AS min_distance, round(avg(CASE WHEN Class = 0 THEN geo_score END), 6) AS mean_geo_score FROM smp GROUP BY realiz""", *POOL_VIEWS))
def realization_summary(spark, folder):
    return audit.realization_summary(combined_samples(spark, folder)).withColumn(
        "min_distance", F.round("min_distance", 6)).withColumn("mean_geo_score", F.round("mean_geo_score", 6))


# The spacing shrinks as points are added, so that the grid grows with them.
GRID = """+b AS (SELECT min(x) AS ax, min(y) AS ay, max(x) AS bx, max(y) AS by_, greatest(1, floor(20000 / sqrt(count(*)))) AS s FROM v_point),
 n AS (SELECT *, CAST(ceil((bx - ax) / s) AS BIGINT) AS nx, CAST(ceil((by_ - ay) / s) AS BIGINT) AS ny FROM b),
 gp AS (SELECT i * ny + j AS grid_ord, i AS x_idx, j AS y_idx, ax + i * s AS x, ay + j * s AS y FROM n, unnest(range(nx)) AS ti(i), unnest(range(ny)) AS tj(j))"""


def fixture_grid(spark, folder):
    b = view(spark, folder, "v_point").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.greatest(F.lit(1), F.floor(20000 / F.sqrt(F.count("*"))))).first()
    return grids.point_grid(spark, b[0], b[1], b[2], b[3], float(b[4]))


@plan("grid_points", with_views(GRID + " SELECT grid_ord, x_idx, y_idx, x, y FROM gp", "v_point"))
def grid_points(spark, folder):
    return fixture_grid(spark, folder)


CANDIDATES = GRID + """, kn AS (SELECT DISTINCT gp.* FROM gp, v_zone WHERE zone_id >= 8 AND x > x1 AND x < x2 AND y > y1 AND y < y2),
 cn AS (SELECT printf('C%08d', row_number() OVER (ORDER BY grid_ord) - 1) AS cand_id, * FROM kn)"""


def fixture_candidates(spark, folder):
    known = polygons.rectangles(view(spark, folder, "v_zone").where("zone_id >= 8"))
    return grids.positive_candidates(fixture_grid(spark, folder), known)


@plan("positive_candidates", with_views(CANDIDATES + " SELECT cand_id, grid_ord, x_idx, y_idx, x, y FROM cn", "v_point", "v_zone"))
def positive_candidates(spark, folder):
    return fixture_candidates(spark, folder).select("cand_id", "grid_ord", "x_idx", "y_idx", "x", "y")


@plan("positive_sample", with_views(CANDIDATES + """, dr AS (SELECT *, row_number() OVER (ORDER BY md5('1|positive|' || cand_id), cand_id) AS pos FROM cn),
 kp AS (SELECT * FROM dr WHERE pos <= (SELECT count(*) // 10 FROM cn) AND NOT EXISTS (SELECT 1 FROM v_zone WHERE zone_id <= 7 AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2))
 SELECT printf('P%07d', row_number() OVER (ORDER BY pos) - 1) AS sample_id, cand_id, x, y FROM kp""", "v_point", "v_zone"))
def positive_sample(spark, folder):
    out = grids.positive_sample(cut(fixture_candidates(spark, folder)), zones(spark, folder, "mine"))
    return out.select("sample_id", "cand_id", "x", "y")


@plan("raster_summary", with_views("""+z AS (SELECT raster, CASE WHEN value <> -9999.0 THEN value END AS v FROM v_pixel)
 SELECT raster, count(*) AS total, count(v) AS valid, round(count(v) / count(*), 6) AS valid_ratio, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM z GROUP BY raster""", "v_pixel"))
def raster_summary(spark, folder):
    out = rasters.summary(view(spark, folder, "v_pixel"), raster_meta(spark))
    return out.select("raster", "total", "valid", *r6("valid_ratio", "min", "max", "mean"))


def unit_pixels(spark, folder):
    return view(spark, folder, "v_pixel").withColumn("value", F.when(F.col("value") == -9999.0, -9999.0).otherwise(F.col("value") / 5000.0))


def sized_meta(spark, folder):
    sizes = view(spark, folder, "v_pixel").groupBy("raster").agg((F.max("r") + 1).cast("bigint").alias("height"), (F.max("c") + 1).cast("bigint").alias("width"))
    return raster_meta(spark).drop("height", "width").join(sizes, "raster")


@plan("raster_overview", with_views("""+s AS (SELECT raster, greatest(1, ceil(greatest(max(r) + 1, max(c) + 1) / 16.0::DOUBLE)) AS f FROM v_pixel GROUP BY raster),
 z AS (SELECT p.raster, CAST(floor(r / f) AS BIGINT) AS r, CAST(floor(c / f) AS BIGINT) AS c, CASE WHEN value <> -9999.0 THEN greatest(0, least(1, value / 5000.0)) END AS v FROM v_pixel p JOIN s USING (raster))
 SELECT raster, r, c, round(avg(v), 9) AS value, count(v) AS cells FROM z GROUP BY raster, r, c""", "v_pixel"))
def raster_overview(spark, folder):
    out = rasters.overview(unit_pixels(spark, folder), sized_meta(spark, folder), 16)
    return out.select("raster", "r", "c", F.round("value", 9).alias("value"), "cells")


@plan("alignment_check", with_views("""+s AS (SELECT raster, max(r) AS h, max(c) AS w, count(CASE WHEN value <> -9999.0 THEN 1 END) AS valid, min(CASE WHEN value <> -9999.0 THEN value / 5000.0 END) AS lo, max(CASE WHEN value <> -9999.0 THEN value / 5000.0 END) AS hi FROM v_pixel GROUP BY raster)
 SELECT s.raster, (s.h = a.h AND s.w = a.w) AS aligned, valid_ AS finite, coalesce(s.lo >= -1e-6 AND s.hi <= 1 + 1e-6, false) AS in_range FROM (SELECT *, valid > 0 AS valid_ FROM s) s, (SELECT * FROM s WHERE raster = 'acct') a""", "v_pixel"))
def alignment_check(spark, folder):
    return rasters.alignment(sized_meta(spark, folder), unit_pixels(spark, folder))


@plan("pixel_centres", with_views("+z AS (SELECT 1) SELECT raster, r, c, round(value, 6) AS value, 500 * (c + CAST(0.5 AS DOUBLE)) AS x, 20000 - 500 * (r + CAST(0.5 AS DOUBLE)) AS y FROM v_pixel", "v_pixel"))
def pixel_centres(spark, folder):
    return rasters.pixel_centres(view(spark, folder, "v_pixel"), raster_meta(spark)).withColumn("value", F.round("value", 6))


def utm_sql(x: str, y: str) -> str:
    n = f"CAST({geodesy.N!r} AS DOUBLE)"
    series = lambda f, arg, k: " ".join(f"- CAST({b!r} AS DOUBLE) * {f(j, arg, k)}" for j, b in enumerate(geodesy.BETA, 1))
    cosh = lambda v: f"((exp({v}) + exp(-({v}))) / 2)"
    sinh = lambda v: f"((exp({v}) - exp(-({v}))) / 2)"
    xi = series(lambda j, a, k: f"sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}", None, n)
    eta = series(lambda j, a, k: f"cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}", None, n)
    lat = " ".join(f"+ CAST({d!r} AS DOUBLE) * sin({2 * j} * chi)" for j, d in enumerate(geodesy.DELTA, 1))
    scale = f"CAST({geodesy.SCALE * geodesy.MERIDIAN!r} AS DOUBLE)"
    return f"""+k AS (SELECT id, ({y} - 10000000) / {scale} AS xi, ({x} - 500000) / {scale} AS eta FROM v_point),
 k1 AS (SELECT id, xi {xi} AS xi1, eta {eta} AS eta1 FROM k),
 k2 AS (SELECT id, xi1, eta1, asin(sin(xi1) / {cosh('eta1')}) AS chi FROM k1),
 ll AS (SELECT id, degrees(chi {lat}) AS lat, 15 + degrees(atan2({sinh('eta1')}, cos(xi1))) AS lon FROM k2)"""


@plan("utm_to_lonlat", with_views(utm_sql("(x + 490000)", "(y + 7500000)") + " SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll", "v_point"))
def utm_to_lonlat(spark, folder):
    points = view(spark, folder, "v_point")
    zone = geodesy.utm_zone(F.lit("WGS 84 / UTM zone 33S"))
    there = geodesy.utm_to_lonlat(F.col("x") + 490000, F.col("y") + 7500000, zone["zone"], zone["south"])
    return points.select("id", there.alias("p")).select("id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@plan("raster_point_lookup", with_views(SAMPLED + " SELECT id, inside, round(value, 6) AS value FROM sv WHERE raster = 'price'", "v_point", "v_pixel"))
def raster_point_lookup(spark, folder):
    """Degrees in, pixel value out: the points travel to degrees and back before the lookup."""
    points = view(spark, folder, "v_point").select("id", geodesy.utm_to_lonlat(F.col("x") + 490000, F.col("y") + 7500000, 33, True).alias("p"))
    back = points.select("id", geodesy.lonlat_to_utm(F.col("p.lon"), F.col("p.lat"), 33, True).alias("q"))
    # Millimetres are lost on the way; the fixture lies on whole metres.
    metres = back.select("id", F.round(F.col("q.x") - 490000, 2).alias("x"), F.round(F.col("q.y") - 7500000, 2).alias("y"))
    out = rasters.sample(metres, view(spark, folder, "v_pixel"), raster_meta(spark).where("raster = 'price'"), "id")
    return out.select("id", "inside", *r6("value"))
