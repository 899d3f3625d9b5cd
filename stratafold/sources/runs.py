"""Run folders: predictions, metrics, ledgers and split manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.sources.files import write_new

PREDICTIONS = (
    "row_index bigint, sample_id string, partition string, block_id bigint, label bigint, "
    "x double, y double, probability double, prediction bigint"
)
LEDGER = (
    "realization int, algorithm string, seed int, status string, return_code int, "
    "elapsed_seconds double, output_dir string, message string"
)
METRICS = (
    "algorithm string, selection_metric string, best_validation_selection_score double, split_sha256 string, "
    "test_metrics map<string,string>, validation_metrics map<string,string>"
)
# Realization and algorithm in a run path (fixed format), also as partition folders that Spark writes.
RUN_PATH = r"realization[_=](\d+)/(?:algorithm=)?([^/]+)/"


def with_run(frame: DataFrame, path=None) -> DataFrame:
    at = F.col("_metadata.file_path") if path is None else path
    return frame.select(
        "*", F.regexp_extract(at, RUN_PATH, 1).try_cast("int").alias("realization"), F.regexp_extract(at, RUN_PATH, 2).alias("algorithm"))


def read_predictions(spark: SparkSession, root: str, pattern: str = "*_predictions.csv") -> DataFrame:
    """All prediction files of all runs as one table keyed by realization and algorithm."""
    raw = spark.read.schema(PREDICTIONS).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    return with_run(raw)


def write_runs(frame: DataFrame, root: str, fmt: str = "csv", rows_per_file: int = 1_000_000) -> None:
    """One folder per (realization, algorithm), all in one job; runs in ``frame`` replace their own folders only.

    Rows are dealt by run before, else every run would have a file from each input partition. A run of more than ``rows_per_file``
    rows is dealt to several tasks and files.
    """
    run = ["realization", "algorithm"]
    sizes = frame.groupBy(*run).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in run]
    spread = F.pmod(F.xxhash64(*[c for c, kind in frame.dtypes if not kind.startswith("map")]), F.col("_files"))
    dealt = frame.join(sizes.select(*[F.col(c).alias(f"_{c}") for c in run], "_files"), same[0] & same[1]).withColumn("_spread", spread)
    writer = dealt.repartition(*run, "_spread").select(*frame.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("maxRecordsPerFile", rows_per_file).partitionBy(*run).format(fmt).option("header", True).save(root)


def write_predictions(rows: DataFrame, root: str, rows_per_file: int = 1_000_000) -> None:
    """Prediction files (columns of ``PREDICTIONS``, realization, algorithm) of all runs."""
    names = [part.split()[0] for part in PREDICTIONS.split(", ")]
    write_runs(rows.select(*names, "realization", "algorithm"), root, "csv", rows_per_file)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("header", True).csv(path)


def read_metrics(spark: SparkSession, root: str, ledger: DataFrame | None = None, pattern: str = "metrics.json") -> DataFrame:
    """(realization, algorithm, split, metric, value) of every finished run."""
    raw = spark.read.schema(METRICS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    runs = with_run(raw.drop("algorithm"))
    if ledger is not None:
        done = ledger.where(F.col("status").isin("completed", "skipped_complete")).select("realization", "algorithm").distinct()
        runs = runs.join(done, ["realization", "algorithm"], "left_semi")
    sides = F.map_concat(
        F.transform_keys("test_metrics", lambda k, v: F.concat(F.lit("test|"), k)),
        F.transform_keys("validation_metrics", lambda k, v: F.concat(F.lit("validation|"), k)))
    tall = runs.select("realization", "algorithm", F.explode(sides).alias("k", "v"))
    return tall.select(
        "realization", "algorithm", F.split("k", r"\|")[0].alias("split"), F.split("k", r"\|")[1].alias("metric"), F.col("v").try_cast("double").alias("value"))


MANIFEST = (
    "split_mode string, grid_size int, bounds string, partitions map<string,array<int>>, split_seed bigint"
)


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(partition, block_id, grid_size, min_x, min_y, max_x, max_y); bounds may be a map or a list of four."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    named = F.from_json("bounds", "min_x double, min_y double, max_x double, max_y double")
    listed = F.from_json("bounds", "array<double>")
    pick = lambda n, i: F.coalesce(named[n], F.get(listed, F.lit(i))).alias(n)
    missing = F.raise_error(F.lit("not a spatial block manifest")).cast("int")
    grid = F.when(F.col("split_mode") == "spatial_block", F.col("grid_size")).otherwise(missing)
    wide = raw.select(
        grid.alias("grid_size"), pick("min_x", 0), pick("min_y", 1), pick("max_x", 2), pick("max_y", 3), F.explode("partitions").alias("partition", "blocks"))
    flat = wide.withColumn("block_id", F.explode("blocks"))
    return flat.select("partition", F.col("block_id").cast("bigint").alias("block_id"), "grid_size", "min_x", "min_y", "max_x", "max_y")


def write_split_manifest(assigned: DataFrame, bounds: DataFrame, grid_size: int, seed: int, path: str) -> None:
    """(block_id, partition) and the one row of ``bounds`` as one JSON document; an existing one is an error.

    The lists hold at most ``grid_size`` squared blocks.
    """
    lists = assigned.groupBy("partition").agg(F.sort_array(F.collect_list("block_id")).alias("blocks"))
    one = lists.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("partition", "blocks")))).alias("partitions"))
    box = bounds.select(F.struct("min_x", "min_y", "max_x", "max_y").alias("bounds"))
    document = one.join(F.broadcast(box)).select(  # one row on either side
        F.lit("spatial_block").alias("split_mode"), F.lit(grid_size).alias("grid_size"), "bounds", "partitions", F.lit(seed).alias("split_seed"))
    write_new(document.coalesce(1), path, "json")
