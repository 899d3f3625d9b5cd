"""Run folders written and read back, boxes and small helpers, each with its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratafold.functions import geodesy, text
from stratafold.operators import experiments, polygons, ranking, splits
from stratafold.plans.metric_plans import RANKED, r6
from stratafold.plans.study_plans import GRID, MANIFEST, SEED, blocked, manifest_blocks
from stratafold.plans.study_plans import PLANS as STUDY
from stratafold.plans.views import table, view, with_views
from stratafold.session import shared_folder
from stratafold.sources import files, runs

PLANS: dict = {}
RERUN = 3  # the realization that is run again


def plan(name: str, sql: str | None = None):
    def add(fn):
        PLANS[name] = (fn, sql)
        return fn
    return add


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def predictions(spark, folder):
    """Rows of prediction files: half of the ids validate, half test."""
    i = F.col("id")
    return view(spark, folder, "v_pred").select(
        i.alias("row_index"), F.concat(F.lit("s"), i).alias("sample_id"), F.when(i % 2 == 0, "validation").otherwise("test").alias("partition"),
        (i % 25).alias("block_id"), "label", (i % 1000).cast("double").alias("x"), (i % 777).cast("double").alias("y"), "probability",
        (F.col("probability") >= 0.5).cast("bigint").alias("prediction"), F.col("realiz").alias("realization"), F.col("model").alias("algorithm"))


# ---- run folders ------------------------------------------------------------

REPLACED = f"""+w_pred AS (SELECT id, realiz, model, label, CASE WHEN realiz = {RERUN} THEN 1 - probability ELSE probability END AS probability FROM v_pred), """


@plan("run_folder_metrics", with_views(REPLACED + RANKED.lstrip("+").replace("v_pred", "w_pred")
      + " SELECT realiz AS realization, model AS algorithm, n, positives, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc FROM m", "v_pred"))
def run_folder_metrics(spark, folder):
    """Prediction files of all runs, one realization run again, evaluated from what lies in the folders."""
    root = place(spark, "runs")
    rows = predictions(spark, folder)
    runs.write_predictions(rows, root)
    again = rows.where(F.col("realization") == RERUN).withColumn("probability", 1 - F.col("probability"))
    runs.write_predictions(again, root)
    back = runs.read_predictions(spark, root, "*.csv")
    found = ranking.ranking_metrics(back, ["realization", "algorithm"], "probability", "label")
    return found.select("realization", "algorithm", "n", "positives", *r6("average_precision", "roc_auc"))


STATUS = "CASE (realization + length(algorithm)) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped_complete' ELSE 'completed' END"


@plan("run_folder_summary", with_views(f"""+a AS (SELECT realiz AS realization, model AS algorithm, CASE WHEN id % 2 = 0 THEN 'validation' ELSE 'test' END AS split,
  CAST(count(*) AS DOUBLE) AS samples, CAST(sum(label) AS DOUBLE) AS positives, avg(probability) AS mean_probability FROM v_pred GROUP BY ALL),
 d AS (SELECT *, CASE WHEN realization = {RERUN} THEN 'completed' ELSE {STATUS} END AS status FROM a)
 SELECT realization, algorithm, split, metric, round(value, 6) AS value FROM (UNPIVOT d ON samples, positives, mean_probability INTO NAME metric VALUE value) WHERE status <> 'failed'""", "v_pred"))
def run_folder_summary(spark, folder):
    """Metrics documents of all finished runs; the ledger is a CSV table, merged with the entries of a rerun."""
    root, book = place(spark, "metrics"), place(spark, "ledger")
    sums = predictions(spark, folder).groupBy("realization", "algorithm", "partition").agg(
        F.count("*").cast("double").alias("samples"), F.sum("label").cast("double").alias("positives"), F.avg("probability").alias("mean_probability"))
    values = F.create_map(*[c for n in ("samples", "positives", "mean_probability") for c in (F.lit(n), F.col(n).cast("string"))])
    sides = sums.withColumn("m", values).groupBy("realization", "algorithm").agg(
        *[F.first(F.when(F.col("partition") == p, F.col("m")), ignorenulls=True).alias(f"{p}_metrics") for p in ("test", "validation")])
    runs.write_runs(sides, root, "json")
    empty = F.lit(None)
    entries = sides.select(
        "realization", "algorithm", F.lit(SEED).alias("seed"), F.expr(STATUS).alias("status"), F.lit(0).alias("return_code"),
        empty.cast("double").alias("elapsed_seconds"), empty.cast("string").alias("output_dir"), empty.cast("string").alias("message"))
    files.write_table(entries, book)
    rerun = entries.where(F.col("realization") == RERUN).withColumn("status", F.lit("completed"))
    ledger = experiments.merge_ledger(runs.read_ledger(spark, book), rerun, ["realization", "algorithm"])
    return runs.read_metrics(spark, root, ledger, "*.json").withColumn("value", F.round("value", 6))


@plan("split_manifest_file", f"""SELECT m."partition" AS "partition", CAST(m.block_id AS BIGINT) AS block_id, {GRID} AS grid_size, b.* FROM ({STUDY["split_manifest"][1]}) AS m,
 ({with_views(" SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v_point", "v_point")}) AS b""")
def split_manifest_file(spark, folder):
    """The block split as a JSON document with the bounds of all realizations, read back."""
    path = place(spark, "manifest")
    box = polygons.bounds(view(spark, folder, "v_point"))
    runs.write_split_manifest(STUDY["split_manifest"][0](spark, folder).select("block_id", "partition"), box, GRID, SEED, path)
    return runs.read_split_manifest(spark, path)


@plan("split_faults", with_views(MANIFEST + """, md AS (SELECT block_id, partition FROM mf WHERE block_id % 7 <> 3 UNION ALL SELECT block_id, 'extra' FROM mf WHERE block_id % 6 = 2),
 r AS (SELECT block_id, label, partition FROM bk LEFT JOIN md USING (block_id) WHERE NOT (coalesce(partition, '') = 'validation' AND label = 1))
 SELECT 'block in several partitions' AS problem, CAST(block_id AS VARCHAR) AS detail FROM md GROUP BY block_id HAVING count(DISTINCT partition) > 1
 UNION ALL SELECT 'block without partition', CAST(block_id AS VARCHAR) FROM r WHERE partition IS NULL GROUP BY block_id
 UNION ALL SELECT 'partition with one class', partition FROM r WHERE partition IS NOT NULL GROUP BY partition HAVING count(DISTINCT label) < 2""", "v_point"))
def split_faults(spark, folder):
    """A damaged split: blocks taken out of the manifest, blocks listed twice, a partition without positives."""
    blocks = manifest_blocks(spark, folder).select("block_id", "partition")
    twice = blocks.where("block_id % 6 = 2").withColumn("partition", F.lit("extra"))
    damaged = blocks.where("block_id % 7 <> 3").unionByName(twice)
    rows = splits.assign_partitions(blocked(spark, folder), damaged)
    return splits.split_problems(rows.where("NOT (coalesce(partition, '') = 'validation' AND label = 1)"), damaged)


@plan("benchmark_runs", with_views("""+g AS (SELECT realiz, model, count(*) AS n FROM v_pred GROUP BY realiz, model),
 a AS (SELECT CAST(r AS INT) AS realization, m AS algorithm FROM range(12) AS t(r), (SELECT unnest(['click', 'view', 'mlp']) AS m))
 SELECT realization, algorithm, 2026 AS seed, printf('realization_%02d/%s/seed_%d', realization, algorithm, 2026) AS path, coalesce(n, 0) AS n FROM a LEFT JOIN g ON realiz = realization AND model = algorithm""", "v_pred"))
def benchmark_runs(spark, folder):
    """Planned runs with their folders and the predictions there are of each."""
    counts = view(spark, folder, "v_pred").groupBy(F.col("realiz").alias("realization"), F.col("model").alias("algorithm")).agg(F.count("*").alias("n"))
    return experiments.benchmark_matrix(spark, 12, ["click", "view", "mlp"], SEED).join(counts, ["realization", "algorithm"], "left").fillna(0, ["n"])


# ---- boxes and helpers ------------------------------------------------------

@plan("layer_bounds", with_views("+z AS (SELECT 1) SELECT realiz, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v_point GROUP BY realiz", "v_point"))
def layer_bounds(spark, folder):
    return polygons.bounds(view(spark, folder, "v_point"), ["realiz"])


@plan("box_filter", with_views("""+b AS (SELECT realiz, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM v_point WHERE label = 1 AND score > 250000 GROUP BY realiz)
 SELECT id, v_point.realiz FROM v_point JOIN b ON b.realiz = v_point.realiz WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""", "v_point"))
def box_filter(spark, folder):
    """Points inside the box of the high positives of their realization, edges included."""
    points = view(spark, folder, "v_point")
    boxes = polygons.bounds(points.where("label = 1 AND score > 250000"), ["realiz"])
    return polygons.within_bounds(points, boxes, ["realiz"]).select("id", "realiz")


@plan("moved_vertices", with_views("+z AS (SELECT 1) SELECT zone_id, 3 * x1 + 2 * x2 + 50 AS sum_x, 2 * (3 * y1 + 2 * y2) AS sum_y FROM v_parcel", "v_parcel"))
def moved_vertices(spark, folder):
    """Every vertex of a nested ring moved, then summed over the flattened rings."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    moved = geodesy.map_vertices(F.array(ring), lambda x, y: F.struct((x + 10).alias("x"), (y * 2).alias("y")))
    flat = view(spark, folder, "v_parcel").select("zone_id", F.flatten(moved).alias("v"))
    total = lambda n: F.aggregate("v", F.lit(0.0), lambda s, p: s + p[n])
    return flat.select("zone_id", total("x").alias("sum_x"), total("y").alias("sum_y"))


@plan("first_artifact", """SELECT doc_id, CASE WHEN contains(lower(source), 'we') THEN source WHEN contains(lower(lang), 'we') THEN lang WHEN contains(lower(source), 'e') THEN source WHEN contains(lower(lang), 'e') THEN lang END AS artifact FROM documents""")
def first_artifact(spark, folder):
    """The first of a document's names that holds a token, tokens tried in order."""
    return table(spark, folder, "documents").select("doc_id", text.first_token(F.array("source", "lang"), ["WE", "e"]).alias("artifact"))


@plan("json_fields", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'none' END AS seed, CASE WHEN c_custkey % 3 <> 2 THEN c_mktsegment END AS segment FROM customer""")
def json_fields(spark, folder):
    """Fields of nested JSON, with a default where a field or its parent is missing."""
    k = F.col("c_custkey")
    seed = F.struct(F.when(k % 3 == 0, k).alias("seed"))
    document = F.to_json(F.struct(F.when(k % 3 != 1, seed).alias("run"), F.when(k % 3 != 2, F.col("c_mktsegment")).alias("segment")))
    rows = table(spark, folder, "customer").select("c_custkey", document.alias("d"))
    return rows.select("c_custkey", text.json_field(F.col("d"), "$.run.seed", "none").alias("seed"), text.json_field(F.col("d"), "$.segment").alias("segment"))
