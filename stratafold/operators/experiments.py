"""Run matrices, ledgers, early stopping and run diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions.text import to_number
from stratafold.operators.ordering import join_groups, prefix_totals

# Statuses of a finished run; smallest gain that counts as progress (fixed values).
DONE = ("completed", "skipped_complete")
MIN_GAIN = 1e-6
# Swept designs (fixed values).
PRIORS = ("dome", "fault", "strata")
SCALES = (("dome-width", 1000.0), ("fault-rate", 0.002), ("strata-width", 800.0))
FACTORS = (("0.5", 0.5), ("2", 2.0))
EXTRA_SEEDS = (2027, 2035)
GRIDS = (4, 10)


def experiment_matrix(spark: SparkSession, realizations: int = 10, algorithms: Sequence[str] = ("prior_mlp", "mlp", "rf")) -> DataFrame:
    """All swept runs with a unique run_key: prior ablations, scales, seeds, block grids, zero prior weight, baseline."""
    base = spark.range(realizations).select(F.col("id").cast("int").alias("realization"))

    def runs(frame, axis, variant, **changes):
        fields = {
            "realization": F.lit(0), "seed": F.lit(2026), "algorithm": F.lit(algorithms[0]), "grid": F.lit(5),
            "omit_prior": F.lit(None).cast("string"), "fixed_weights": F.lit(False), "scale_argument": F.lit(None).cast("string"),
            "scale_value": F.lit(None).cast("double"), "prior_weight": F.lit(0.1), **changes}
        return frame.select(F.lit(axis).alias("axis"), variant.alias("variant"), *[c.alias(n) for n, c in fields.items()])

    one = spark.range(1)
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    per_run = {"realization": F.col("realization")}
    ablated = runs(base.select("*", each(PRIORS).alias("p")), "negative_realization", F.concat(F.lit("without_"), "p"), **per_run, omit_prior=F.col("p"))
    frozen = runs(base, "negative_realization", F.lit("fixed_weights"), **per_run, fixed_weights=F.lit(True))
    zero = runs(base, "negative_realization", F.lit("strict_zero_regularization"), **per_run, prior_weight=F.lit(0.0))
    pair = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(f"{a}_x{t}").alias("v"), F.lit(d * f).alias("s")) for a, d in SCALES for t, f in FACTORS])
    scaled = runs(one.select(F.inline(pair)), "prior_scale", F.col("v"), scale_argument=F.col("a"), scale_value=F.col("s"))
    seeds = runs(one.select(F.explode(F.sequence(F.lit(EXTRA_SEEDS[0]), F.lit(EXTRA_SEEDS[1]))).alias("s")), "initialization", F.lit("full"), seed=F.col("s"))
    grid = runs(
        one.select(each(GRIDS).alias("g")).select("g", each(algorithms).alias("m")), "spatial_grid",
        F.concat(F.lit("grid"), F.col("g").cast("string"), F.lit("_"), F.col("m")), grid=F.col("g"), algorithm=F.col("m"))
    baseline = runs(one, "baseline", F.lit("full"))
    out = ablated
    for part in (frozen, zero, scaled, seeds, grid, baseline):
        out = out.unionByName(part)
    key = F.format_string("%s/%s/realization_%02d/seed_%d", F.col("axis"), F.col("variant"), F.col("realization"), F.col("seed"))
    return out.withColumn("run_key", key)


def benchmark_matrix(spark: SparkSession, realizations: int, algorithms: Sequence[str], seed: int = 2026) -> DataFrame:
    base = spark.range(realizations).select(
        F.col("id").cast("int").alias("realization"), F.explode(F.array(*[F.lit(a) for a in algorithms])).alias("algorithm"))
    path = F.format_string("realization_%02d/%s/seed_%d", F.col("realization"), F.col("algorithm"), F.lit(seed))
    return base.withColumn("seed", F.lit(seed)).withColumn("path", path)


def repeated_keys(matrix: DataFrame, key: str = "run_key") -> DataFrame:
    return matrix.groupBy(key).agg(F.count("*").alias("runs")).where("runs > 1")


def pending(matrix: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs without a finished ledger entry."""
    return matrix.join(ledger.where(F.col("status").isin(*DONE)).select(*keys).distinct(), list(keys), "left_anti")


def ledger_status(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status").isin(*DONE)).alias("finished"),
        F.count_if(F.col("status") == "failed").alias("failed"))


def merge_ledger(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger after a batch of runs: new entries replace old ones with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def finished(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status").isin(*DONE))


def _replayed(records: DataFrame, keys: Sequence[str], patience: int) -> DataFrame:
    """(keys, _best, _last, _stop): the early-stop rule over each run's running maxima (_at, _s), one state at a time."""
    names = [*keys, "_best", "_last", "_stop"]

    def run(batches):
        import pyarrow as pa
        group, best, last, stop, kinds = None, None, 0, None, None
        done = []

        def out():
            arrays = [pa.array([r[0][i] for r in done], kind) for i, kind in enumerate(kinds)]
            arrays += [pa.array([r[i] for r in done], kind) for i, kind in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            for *own, at, score in zip(*(batch.column(c).to_pylist() for c in (*keys, "_at", "_s"))):
                if own != group:
                    if group is not None:
                        done.append((group, best, last, stop))
                    group, best, last, stop = own, None, 0, None
                if stop is None and at > last + patience:
                    stop = last + patience
                if stop is None and (best is None or score > best + MIN_GAIN):
                    best, last = score, at
            if done:
                yield out()
        if group is not None:
            done.append((group, best, last, stop))
            yield out()

    dealt = records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else records.repartition(1)
    declared = "".join(f"`{k}` {records.schema[k].dataType.simpleString()}, " for k in keys)
    return dealt.sortWithinPartitions(*keys, "_at").mapInArrow(run, f"{declared}_best double, _last bigint, _stop bigint")


def best_checkpoint(history: DataFrame, keys: Sequence[str], epoch: str, score: str, patience: int, rows: int | None = None) -> DataFrame:
    """(keys, best_epoch, best_score, stop_epoch) of an early-stopped run.

    A score improves when it beats the last improvement by more than 1e-6;
    missing scores never do. The run stops ``patience`` epochs after its last
    improvement. Every improvement is a new running maximum, so the sequential
    rule is replayed over those rows only, as a stream that holds one state.
    """
    keys = list(keys)
    value = F.when(F.isnan(F.col(score)), F.lit(None)).otherwise(F.col(score).cast("double"))
    data = history.select(*keys, F.col(epoch).cast("bigint").alias("_e"), value.alias("_s"))
    placed = prefix_totals(
        data, keys, [F.col("_e").asc()], maxima={"_max": F.col("_s")}, totals={"_end": F.lit(1).cast("bigint")}, position="_at", rows=rows)
    # The first row that reaches each maximum value.
    records = placed.where(F.col("_s") == F.col("_max")).groupBy(*keys, "_s").agg(F.min("_at").alias("_at"), F.max("_end").alias("_end"))
    states = _replayed(records.select(*keys, "_s", "_at"), keys, patience)
    ends = placed.groupBy(*keys).agg(F.max("_end").alias("_end"))
    joined = join_groups(ends, states, keys) if keys else ends.join(F.broadcast(states), how="left")  # one row
    last = F.coalesce("_last", F.lit(0))
    stop = F.coalesce("_stop", F.least(F.col("_end"), last + patience))
    final = joined.select(*keys, F.col("_best").alias("best_score"), last.alias("_last"), stop.alias("_stop"))
    at = placed.select(*keys, "_at", "_e").join(final, keys) if keys else placed.select("_at", "_e").join(F.broadcast(final))
    return at.where(F.col("_at").isin(F.col("_last"), F.col("_stop"))).groupBy(*keys, "best_score").agg(
        F.max(F.when(F.col("_at") == F.col("_last"), F.col("_e"))).alias("best_epoch"),
        F.max(F.when(F.col("_at") == F.col("_stop"), F.col("_e"))).alias("stop_epoch"))


def diagnostic_bands(runs: DataFrame) -> DataFrame:
    """Verbal bands per run from test_auc, val_auc, test_precision, test_recall and valid_ratio."""
    auc, val = to_number(F.col("test_auc")), to_number(F.col("val_auc"))
    p, r, ratio = to_number(F.col("test_precision")), to_number(F.col("test_recall")), to_number(F.col("valid_ratio"))
    strength = F.when(auc.isNull(), "unavailable").when(auc >= 0.95, "strong").when(auc >= 0.90, "good").otherwise("moderate")
    balance = (
        F.when(p.isNull() | r.isNull(), "incomplete").when(r + 0.08 < p, "precision above recall")
        .when(p + 0.08 < r, "recall above precision").otherwise("balanced"))
    drift = F.when(auc.isNull() | val.isNull(), "unavailable").when(F.abs(auc - val) <= 0.02, "stable").otherwise("drift")
    cover = F.when(ratio.isNull(), "unavailable").when(ratio >= 0.98, "high").when(ratio >= 0.90, "slightly reduced").otherwise("low")
    return runs.select(
        "*", strength.alias("discrimination"), balance.alias("tradeoff"), drift.alias("generalization"), cover.alias("raster_coverage"))


def evidence_checklist(items: DataFrame, keys: Sequence[str], verified: str) -> DataFrame:
    agg = items.groupBy(*keys).agg(F.count_if(F.col(verified)).alias("verified"), F.count("*").alias("total"))
    return agg.withColumn("missing", F.col("total") - F.col("verified"))


def best_prediction_file(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best raster per job, newest first among equals. Folder and name words and their points are fixed values."""
    low = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    stem = F.regexp_extract(low, r"([^/]*)\.tiff?$", 1)
    score = F.when(low.contains("output/predict/"), 2).otherwise(0) + F.when(stem.contains("prob"), 2).otherwise(0)
    raster = files.where(low.rlike(r"\.tiff?$")).withColumn("_score", score)
    return raster.groupBy(*keys).agg(F.max_by("path", F.struct("_score", "modified", "path")).alias("path"))


def top_features(importance: DataFrame, n: int = 10, feature: str = "feature", value: str = "importance") -> DataFrame:
    return importance.orderBy(F.col(value).desc(), F.col(feature).asc()).limit(n)
