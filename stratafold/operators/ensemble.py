"""Rank ensembles: component merge, weight grid, selection and scoring; member moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators.ordering import join_groups, largest_group, small_side
from stratafold.operators.ranking import ranking_metrics, top_fraction
from stratafold.session import cut

# Coordinates of one sample may differ by this much between components (fixed value).
COORDINATE_ATOL = 1e-6
# Rows of a run whose scores are counted together, one weight vector at a time.
ROWS_PER_BLOCK = 1 << 16


def weight_grid(spark: SparkSession, names: Sequence[str], step: float) -> DataFrame:
    """All nonnegative multiples of ``step`` that sum to 1, one row per vector."""
    units = round(1.0 / step)
    if units < 1 or abs(units * step - 1.0) > 1e-9:
        raise ValueError("the step must divide 1 evenly")
    grid = spark.range(1).select(F.lit(units).alias("_left"))
    for name in names[:-1]:
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("_left"))).alias(f"_u_{name}")).withColumn(
            "_left", F.col("_left") - F.col(f"_u_{name}")
        )
    grid = grid.withColumnRenamed("_left", f"_u_{names[-1]}")
    return grid.select(*[(F.col(f"_u_{n}") / F.lit(float(units))).alias(f"w_{n}") for n in names])


def weighted_score(names: Sequence[str], ranks: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for name, rank in zip(names, ranks):
        total = total + F.col(f"w_{name}") * F.col(rank)
    return total


def merge_components(
    frames: dict[str, DataFrame], geo: DataFrame, partition: str, *, on: str = "sample_id"
) -> tuple[DataFrame, DataFrame]:
    """Inner 1:1 merge of the model scores of one partition with the prior scores.

    The first result holds the samples present everywhere and consistent; the
    second lists every (sample, problem) among them: duplicate, label or
    coordinate disagreement. Callers reject a merge whose second table is not empty.
    """
    sides = {**frames, "geo_score": geo}
    tall = None
    for name, frame in sides.items():
        if "partition" in frame.columns:  # the prior layer covers all partitions
            frame = frame.where(F.col("partition") == partition)
        part = frame.select(
            F.col(on), F.lit(name).alias("component"), F.col("label").cast("bigint").alias("label"),
            F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
            F.col("score").cast("double").alias("score"),
        )
        tall = part if tall is None else tall.unionByName(part)
    # One aggregate replaces the chain of joins: rows meet on the sample id once.
    folded = tall.groupBy(on).agg(
        F.count("*").alias("_rows"),
        F.min("label").alias("label"), F.max("label").alias("_label_max"),
        F.min("x").alias("x"), F.max("x").alias("_x_max"),
        F.min("y").alias("y"), F.max("y").alias("_y_max"),
        *[F.max(F.when(F.col("component") == n, F.col("score"))).alias(f"score_{n}") for n in sides],
        *[F.max(F.when(F.col("component") == n, 1)).alias(f"_has_{n}") for n in sides],
    ).na.drop("any", subset=[f"_has_{n}" for n in sides])
    problems = F.array_compact(F.array(
        F.when(F.col("_rows") > len(sides), F.lit("duplicate")),
        F.when(F.col("label") != F.col("_label_max"), F.lit("label")),
        F.when((F.col("_x_max") - F.col("x") > COORDINATE_ATOL) | (F.col("_y_max") - F.col("y") > COORDINATE_ATOL), F.lit("coordinate")),
    ))
    checked = folded.withColumn("_problems", problems)
    good = checked.where(F.size("_problems") == 0).select(on, "label", "x", "y", *[f"score_{n}" for n in sides])
    bad = checked.select(on, F.explode("_problems").alias("problem"))
    return good, bad


def _with_weights(df: DataFrame, names: Sequence[str], units: int) -> DataFrame:
    """Every row once per weight vector, as whole numbers ``_u_<name>`` that sum to ``units``."""
    out = df.withColumn("_left", F.lit(units))
    for name in names[:-1]:
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("_left"))).alias(f"_u_{name}")).withColumn(
            "_left", F.col("_left") - F.col(f"_u_{name}"))
    return out.withColumnRenamed("_left", f"_u_{names[-1]}")


def part_counts(df: DataFrame, vectors: DataFrame, keys: Sequence[str], names: Sequence[str], ranks: Sequence[str], label: str, units: int, bins: int, blocks: int) -> DataFrame:
    """(keys, vector, _part, _n, _p): rows and positives of each run and vector by score, in ``bins`` equal parts of 0 to 1.

    The rows of a run are dealt to ``blocks``, each of which counts for one vector after another, so rows are never
    multiplied by vectors: what leaves a block is at most one row a vector and part.
    """
    keys, vector = list(keys), [f"_u_{n}" for n in names]
    rows = df.select(*keys, F.col(label).cast("double").alias("_label"), *ranks, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("_block"))
    asked = vectors.select(*keys, *vector, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    asked = asked.select(*[F.col(c).alias(f"_for_{c}") for c in (*keys, "_block")], *vector)
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *[T.StructField(v, T.IntegerType()) for v in vector],
                           T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_p", T.LongType())])

    def count(held: pa.Table, wanted: pa.Table) -> pa.Table:
        values = [held[c].to_numpy().astype(float) for c in ranks]
        positive = np.nan_to_num(held["_label"].to_numpy().astype(float))
        weights = np.stack([wanted[v].to_numpy() for v in vector], axis=1) / float(units)
        found = []
        for i, own in enumerate(weights.tolist() if held.num_rows else []):
            total = np.zeros(held.num_rows)
            for w, v in zip(own, values):
                total = total + w * v
            part = np.clip(np.floor(np.round(total, 12) * bins), 0, bins - 1).astype(np.int64)
            n = np.bincount(part, minlength=bins)
            at = np.flatnonzero(n)
            found.append((np.full(len(at), i), at, n[at], np.bincount(part, positive, bins)[at].astype(np.int64)))
        row, part, n, p = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        own = wanted.take(pa.array(row))
        return pa.table([*[own[f"_for_{k}"] for k in keys], *[own[v] for v in vector], pa.array(part, pa.int32()), pa.array(n), pa.array(p)], names=schema.names)

    return rows.groupBy(*keys, "_block").cogroup(asked.groupBy(*[f"_for_{c}" for c in (*keys, "_block")])).applyInArrow(count, schema)


def precision_bounds(df: DataFrame, keys: Sequence[str], vector: Sequence[str], score: Column, label: str, bins: int) -> DataFrame:
    """(keys, vector, low, high): bounds of average precision from counts of scores in ``bins`` equal parts of 0 to 1."""
    part = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*keys, *vector, part.alias("_part")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    return bounds_of(counts, [*keys, *vector])


def bounds_of(counts: DataFrame, run: Sequence[str]) -> DataFrame:
    """(run, low, high): bounds of average precision from rows and positives by part.

    With n rows and p positives in a part, N rows and P positives above it, each of its positives counts at most
    (P + p) / (N + p), and the i-th at least (P + i) / (N + n - p + i), whatever the order and the ties inside.
    """
    counts = counts.groupBy(*run, "_part").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    # At most ``bins`` rows a vector.
    order = Window.partitionBy(*run).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_over", F.sum("_n").over(order) - F.col("_n")).withColumn("_hits", F.sum("_p").over(order) - F.col("_p"))
    high = F.col("_p") * (F.col("_hits") + F.col("_p")) / F.greatest(F.col("_over") + F.col("_p"), F.lit(1))
    below = F.col("_over") + F.col("_n") - F.col("_p")
    # The sum of 1 / (below + i) is at most the logarithm.
    low = F.when(below > 0, F.greatest(F.col("_p") - (below - F.col("_hits")) * F.log((below + F.col("_p")) / F.greatest(below, F.lit(1))), F.lit(0.0))).otherwise(F.col("_p"))
    sums = counts.groupBy(*run).agg(F.sum("_p").alias("_all"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    positives = F.nullif(F.col("_all"), F.lit(0))
    return sums.select(*run, (F.col("low") / positives).alias("low"), (F.col("high") / positives).alias("high"))


def surviving_vectors(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], ranks: Sequence[str], label: str, units: int, bins: Sequence[int], rows: int | None = None,
) -> DataFrame:
    """(keys, ``_u_*``): the vectors whose average precision may be the best of their run, after histograms of ever finer ``bins``.

    Runs without positives keep every vector. ``rows`` is an upper bound of the largest run.
    """
    keys, vector = list(keys), [f"_u_{n}" for n in names]
    if rows is None:
        rows = largest_group(df, keys)
    left = _with_weights(df.select(*keys).distinct() if keys else df.sparkSession.range(1).select(), names, units)
    for number in bins:
        counts = part_counts(df, left, keys, names, ranks, label, units, number, max(1, -(-rows // ROWS_PER_BLOCK)))
        found = cut(bounds_of(counts, [*keys, *vector]))
        best = found.groupBy(*keys).agg(F.max("low").alias("_best"))
        found = join_groups(found, best, keys)
        left = cut(found.where(F.col("high").isNull() | (F.col("high") >= F.col("_best") - 1e-9)).select(*keys, *vector))
    return left


def _of_run(df: DataFrame, vectors: DataFrame, keys: Sequence[str], vector: Sequence[str]) -> DataFrame:
    """Every row once per vector left for its run; a run's vectors (at most the grid) travel as one row."""
    listed = vectors.groupBy(*keys).agg(F.collect_list(F.struct(*vector)).alias("_vectors"))
    joined = join_groups(df, small_side(listed, F.size("_vectors")), keys)
    return joined.select(*df.columns, F.inline("_vectors"))


def _score(names: Sequence[str], ranks: Sequence[str], units: int) -> Column:
    total = F.lit(0.0)
    for name, rank in zip(names, ranks):
        total = total + F.col(f"_u_{name}") / F.lit(float(units)) * F.col(rank)
    return F.round(total, 12)


def select_weights(
    df: DataFrame,
    keys: Sequence[str],
    label: str,
    row_id: str,
    ranks: dict[str, str],
    step: float,
    prior_component: str | None = None,
    rows: int | None = None,
    bins: Sequence[int] = (64, 1024),
) -> DataFrame:
    """Best weight vector per run by (AP, top-5 % capture, small prior weight, few parts, weights).

    Every vector of the grid is bounded from histograms of its scores, which costs no shuffle of rows; only vectors that
    may be the best are then evaluated exactly. Ranks lie between 0 and 1.
    """
    names, keys = list(ranks), list(keys)
    units = round(1.0 / step)
    if units < 1 or abs(units * step - 1.0) > 1e-9:
        raise ValueError("the step must divide 1 evenly")
    vector = [f"_u_{n}" for n in names]
    if rows is None:
        rows = largest_group(df, keys)
    left = surviving_vectors(df, keys, names, list(ranks.values()), label, units, bins, rows)
    wide = _of_run(df.select(*keys, row_id, label, *ranks.values()), left, keys, vector)
    scored = wide.withColumn("_score", _score(names, list(ranks.values()), units))
    run = [*keys, *vector]
    ap = ranking_metrics(scored, run, "_score", label, rows)
    top = top_fraction(scored, run, "_score", label, row_id, (0.05,), rows).select(*run, "capture")
    parts = F.lit(0)
    for name in vector:
        parts = parts + F.when(F.col(name) > 0, 1).otherwise(0)
    weights = [(F.col(f"_u_{n}") / F.lit(float(units))).alias(f"w_{n}") for n in names]
    prior = F.col(f"_u_{prior_component}") if prior_component else F.lit(0)
    order = F.struct(
        F.round("average_precision", 10).alias("_1"), F.round("capture", 10).alias("_2"), (-prior).alias("_3"), (-parts).alias("_4"), *weights)
    chosen = F.struct(*weights, "average_precision", "capture")
    best = join_groups(ap, top, run).groupBy(*keys).agg(F.max_by(chosen, order).alias("_best"))
    return best.select(*keys, "_best.*")


def member_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample spread over ensemble members, spread 0 for one member."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("members"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )


def member_ranges(df: DataFrame, member: str, value: str) -> DataFrame:
    return df.groupBy(member).agg(
        F.count(value).alias("cells"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )
