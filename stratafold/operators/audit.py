"""Checks that return tables of findings instead of stopping at the first one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Slack of the minimum distance in metres (fixed value).
DISTANCE_SLACK = 1e-6

# Largest text of a source file in bytes, allowed endings and names (fixed values).
MAX_SOURCE_BYTES = 2_000_000
ALLOWED_SUFFIXES = (
    ".py", ".md", ".txt", ".json", ".toml", ".yml", ".yaml", ".html", ".cff", ".lock",
)
ALLOWED_NAMES = (".gitignore", ".gitattributes")
RESTRICTED_DIRECTORIES = (
    "data", "raw", "results", "runs", "experiments", "analysis_output",
    "publication_figures", "checkpoints", "uploads", "site-packages",
)
ALLOWED_MODES = ("100644", "100755")
# Credential shapes by finding name (fixed values).
SECRET_PATTERNS = {
    "private-key material": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "GitHub credential": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})\b",
    "cloud access-key identifier": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "service API credential": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{32,}\b",
    "literal credential assignment":
        r"(?im)\b(?:api_key|access_token|auth_token|password|client_secret)\s*[:=]\s*[\"'][A-Za-z0-9_+/=-]{20,}[\"']",
    "credential-bearing URL": r"https?://[^\s/@:]+:[^\s/@]+@",
}


def content_findings(files: DataFrame) -> DataFrame:
    """(path, finding) for a table (path, content BINARY, mode); matched values are never returned."""
    path, content = F.col("path"), F.col("content")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    name = F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit(""))
    # An ending needs something on both sides of the last dot.
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    decoded = F.is_valid_utf8(content.cast("string"))
    text = F.when(decoded, content.cast("string"))
    checks = [
        (path.startswith("/") | F.array_contains(parts, ".."), "non-relative path"),
        (~F.col("mode").isin(*ALLOWED_MODES), "symlink, submodule or unsupported Git mode"),
        (F.exists(parts, lambda p: F.lower(p).isin(*RESTRICTED_DIRECTORIES)), "controlled data/output/dependency directory"),
        (name.startswith(".env"), "environment/credential file"),
        (~name.isin(*ALLOWED_NAMES) & ~suffix.isin(*ALLOWED_SUFFIXES), "non-source artifact type"),
        (F.octet_length(content) > MAX_SOURCE_BYTES, "oversized source file; review required"),
        (~decoded, "binary or non-UTF-8 content"),
        (text.contains("\x00"), "binary content"),
        *[(text.rlike(pattern), finding) for finding, pattern in SECRET_PATTERNS.items()],
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for test, n in checks]))
    return files.select("path", F.explode(found).alias("finding"))


def sample_checks(
    samples: DataFrame, keys: Sequence[str] = (), *, expected_positive: int | None = None,
    expected_negative: int | None = None, minimum_distance: float | None = None,
) -> DataFrame:
    """(keys, check, passed, observed) over sample tables: labels, counts, uniqueness, distance.

    Uniqueness is decided from pre-aggregated distinct counts, so no group of
    rows is ever gathered in one place.
    """
    missing = [c for c in ("sample_id", "Class", "x", "y") if c not in samples.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    keys = list(keys)
    negative = F.col("Class") == 0
    columns = [
        F.count("*").alias("n"), F.count_if(F.col("Class") == 1).alias("pos"), F.count_if(negative).alias("neg"),
        F.count_if(~F.col("Class").isin(0, 1) | F.col("Class").isNull()).alias("bad"),
    ]
    if "mine_dist" in samples.columns:
        columns.append(F.min(F.when(negative, F.col("mine_dist"))).alias("near"))
    base = samples.groupBy(*keys).agg(*columns)

    def repeats(frame, cols, name):
        counts = frame.groupBy(*keys, *cols).agg(F.count("*").alias("_n"))
        return counts.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias(name))

    tables = [repeats(samples, ["sample_id"], "dup_id"), repeats(samples, ["x", "y"], "dup_xy")]
    if "thin_id" in samples.columns:
        tables.append(repeats(samples.where(negative), ["thin_id"], "dup_thin"))
    for extra in tables:
        base = base.join(extra, keys, "left") if keys else base.join(F.broadcast(extra))  # one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = [
        ("binary labels", F.col("bad") == 0, F.col("bad")),
        ("both classes", (F.col("pos") > 0) & (F.col("neg") > 0), F.least("pos", "neg")),
        ("unique ids", zero("dup_id") == 0, zero("dup_id")),
        ("unique coordinates", zero("dup_xy") == 0, zero("dup_xy")),
    ]
    if "thin_id" in samples.columns:
        rows.append(("unique thinning cells", zero("dup_thin") == 0, zero("dup_thin")))
    if expected_positive is not None:
        rows.append(("positive count", F.col("pos") == expected_positive, F.col("pos")))
    if expected_negative is not None:
        rows.append(("negative count", F.col("neg") == expected_negative, F.col("neg")))
    if minimum_distance is not None:
        ok = F.coalesce(F.col("near") >= F.lit(minimum_distance - DISTANCE_SLACK), F.lit(True))
        rows.append(("minimum distance", ok, F.col("near")))
    checks = F.array(*[
        F.struct(F.lit(n).alias("check"), p.alias("passed"), o.cast("double").alias("observed")) for n, p, o in rows])
    return base.select(*keys, F.inline(checks))


def realization_summary(samples: DataFrame, keys: Sequence[str] = ("realiz",)) -> DataFrame:
    negative = F.col("Class") == 0
    return samples.groupBy(*keys).agg(
        F.count_if(F.col("Class") == 1).alias("positive"), F.count_if(negative).alias("negative"),
        *[F.count_if(negative & (F.col("stratum") == s)).alias(s) for s in ("hard", "transition", "background")],
        F.countDistinct(F.when(negative, F.col("block_id"))).alias("unique_blocks"),
        F.countDistinct(F.when(negative, F.col("thin_id"))).alias("unique_thin_cells"),
        F.min(F.when(negative, F.col("mine_dist"))).alias("min_distance"),
        F.avg(F.when(negative, F.col("geo_score"))).alias("mean_geo_score"),
    )


def rerun_gate(
    left: DataFrame, right: DataFrame, on: Sequence[str], numeric: Sequence[str], exact: Sequence[str], tolerance: float
) -> DataFrame:
    """(column, max_difference, unmatched, passed) of two runs on the same keys."""
    on = list(on)
    lost = F.count_if(F.col("a._seen").isNull() | F.col("b._seen").isNull())
    a, b = left.withColumn("_seen", F.lit(1)).alias("a"), right.withColumn("_seen", F.lit(1)).alias("b")
    joined = a.join(b, on, "full_outer")
    columns = [lost.alias("unmatched")]
    for name in numeric:
        columns.append(F.max(F.abs(F.col(f"a.{name}") - F.col(f"b.{name}"))).alias(f"n_{name}"))
    for name in exact:
        columns.append(F.count_if(~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))).cast("double").alias(f"e_{name}"))
    agg = joined.agg(*columns)
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"n_{n}").alias("max_difference"), F.lit(float(tolerance)).alias("tol")) for n in numeric]
    rows += [F.struct(F.lit(n).alias("column"), F.col(f"e_{n}").alias("max_difference"), F.lit(0.0).alias("tol")) for n in exact]
    return agg.select("unmatched", F.inline(F.array(*rows))).select(
        "column", "max_difference", "unmatched", ((F.col("max_difference") <= F.col("tol")) & (F.col("unmatched") == 0)).alias("passed"))


def frame_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows present on one side only (with multiplicity), marked left or right."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def recorded_mismatch(computed: DataFrame, recorded: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """(keys, metric, computed, recorded, passed) of recomputed metrics against recorded ones."""
    joined = computed.alias("c").join(recorded.alias("r"), list(keys))
    rows = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"c.{n}").alias("computed"), F.col(f"r.{n}").alias("recorded")) for n in columns])
    tall = joined.select(*keys, F.inline(rows))
    same = F.col("computed").eqNullSafe(F.col("recorded")) | (F.abs(F.col("computed") - F.col("recorded")) <= tolerance)
    return tall.withColumn("passed", F.coalesce(same, F.lit(False)))


def single_value(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values per group of columns that must be constant within it."""
    agg = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in columns])
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(c) == 1)
    return agg.withColumn("passed", ok)


def selection_protocol(runs: DataFrame, tree_models: Sequence[str], deep_models: Sequence[str]) -> DataFrame:
    """Protocol label or problem per run.

    Tree models must be one untuned fit; deep models must be configured and
    recorded as selected by average precision, with a selected score equal to
    the validation one. Needs algorithm, optimizer, configured_metric,
    recorded_metric, selected_score and validation_ap columns.
    """
    tree, deep = F.col("algorithm").isin(list(tree_models)), F.col("algorithm").isin(list(deep_models))
    selected, valid = F.col("selected_score"), F.col("validation_ap")
    close = F.abs(selected - valid) <= F.greatest(F.lit(1e-12), F.lit(1e-9) * F.greatest(F.abs(selected), F.abs(valid)))
    by_ap = (F.col("configured_metric") == "pr_auc") & (F.col("recorded_metric") == "pr_auc")
    problem = (
        F.when(tree & ~F.coalesce(F.col("optimizer") == "none", F.lit(False)), "not a single fit")
        .when(~tree & ~deep, "unknown algorithm")
        .when(deep & ~F.coalesce(by_ap, F.lit(False)), "not selected by validation average precision")
        .when(deep & (selected.isNull() | valid.isNull()), "selection evidence is missing")
        .when(deep & ~close, "selected score differs from the validation score")
    )
    label = F.when(tree, "single_fit_no_checkpoint").otherwise("validation_pr_auc_checkpoint")
    return runs.withColumn("problem", problem).withColumn("protocol", F.when(problem.isNull(), label))
