"""Ordered prefix totals that survive hot groups.

A plain window puts a whole group into one task. Groups are therefore counted
first: if the largest one fits ``spark.stratafold.windowRows`` the window is
used as is, otherwise rows are range partitioned on (keys, order), written
once so that the slice of a row can never change, and the totals of the
preceding slices of a group are added to a window local to (slice, group).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.session import (
    BROADCAST_ROWS_DEFAULT,
    BROADCAST_ROWS_KEY,
    WINDOW_ROWS_DEFAULT,
    WINDOW_ROWS_KEY,
    cut,
    int_conf,
)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group (one small aggregate over the key columns)."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def fits_window(df: DataFrame, rows: int) -> bool:
    return rows <= int_conf(df.sparkSession, WINDOW_ROWS_KEY, WINDOW_ROWS_DEFAULT)


def small_side(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Broadcast ``df`` only if its counted rows (or summed weight) are few.

    The probe reads at most limit + 1 rows; a larger side is joined by a shuffle, also where Spark, which does not
    count exploded rows, takes it for small.
    """
    limit = int_conf(df.sparkSession, BROADCAST_ROWS_KEY, BROADCAST_ROWS_DEFAULT)
    probe = df.select((weight if weight is not None else F.lit(1)).alias("w")).limit(limit + 1)
    rows, total = probe.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and total <= limit else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: its join is a merge join, never a broadcast by an estimate."""
    return df.hint("merge")


def null_safe(left: str, right: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def join_groups(groups: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``groups`` with the columns of ``values``; NULL keys meet and groups without values keep NULLs."""
    named = values.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in values.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return groups.join(named, condition, "left").drop(*[f"_key_{k}" for k in keys])


def prefix_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    position: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add running sums/maxima (current row included), group totals and 1-based positions.

    ``order`` must be unique within a group. ``rows`` is a known upper bound
    of the largest group; it is counted when absent.
    """
    keys = list(keys)
    sums = dict(sums or {})
    maxima = dict(maxima or {})
    totals = dict(totals or {})
    if rows is None:
        rows = largest_group(df, keys)
    if fits_window(df, rows):
        return _windowed(df, keys, order, sums, maxima, totals, position)
    return _sliced(df, keys, order, sums, maxima, totals, position, rows)


def _windowed(df, keys, order, sums, maxima, totals, position):
    frame = Window.partitionBy(*keys).orderBy(*order)
    running = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    added = {name: F.sum(c).over(running) for name, c in sums.items()}
    added |= {name: F.max(c).over(running) for name, c in maxima.items()}
    added |= {name: F.sum(c).over(whole) for name, c in totals.items()}
    if position:
        added[position] = F.row_number().over(frame).cast("bigint")
    return df.select("*", *[c.alias(name) for name, c in added.items()])


def slice_count(df: DataFrame, rows: int) -> int:
    """Range slices for a largest group of ``rows``, which may be a third of the table.

    Slices stream their running sums, so they may hold ten times a plain window.
    """
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_slice = 10 * int_conf(spark, WINDOW_ROWS_KEY, WINDOW_ROWS_DEFAULT)
    return max(base, -(-3 * rows // per_slice)) if per_slice else base


def _sliced(df, keys, order, sums, maxima, totals, position, rows):
    if position:
        sums = {**sums, position: F.lit(1).cast("bigint")}
    adders = {**sums, **totals}
    slices = slice_count(df, rows)
    ranged = cut(
        df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    per_slice = ranged.groupBy("_slice", *keys).agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in adders.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in maxima.items()],
        F.count("*").alias("_rows"),
    )
    # At most one row per (group, slice): a group spans no more rows here than there are slices.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_slice.select(
        "_slice", *keys,
        *[F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in sums],
        *[F.max(f"_max_{n}").over(before).alias(f"_off_{n}") for n in maxima],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"_all_{n}") for n in totals],
    )
    local = (
        Window.partitionBy("_slice", *keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    body = ranged.select(
        "*",
        *[F.sum(c).over(local).alias(f"_loc_{n}") for n, c in sums.items()],
        *[F.max(c).over(local).alias(f"_loc_{n}") for n, c in maxima.items()],
    )
    joined = body.alias("b").join(offsets.alias("o"), null_safe("b", "o", ["_slice", *keys]))
    picked = [F.col(f"b.{c}") for c in df.columns]
    picked += [
        # NULL-only prefixes stay NULL, as in a plain window.
        F.when(F.col(f"o._off_{n}").isNull(), F.col(f"b._loc_{n}"))
        .otherwise(F.col(f"o._off_{n}") + F.coalesce(F.col(f"b._loc_{n}"), F.lit(0)))
        .alias(n)
        for n in sums
    ]
    picked += [F.greatest(F.col(f"o._off_{n}"), F.col(f"b._loc_{n}")).alias(n) for n in maxima]
    picked += [F.col(f"o._all_{n}").alias(n) for n in totals]
    return joined.select(*picked)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    rows: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, NULLs ignored.

    Small groups use the built-in aggregate (it keeps a group's distinct
    values in one task); larger ones pick the two neighbouring order
    statistics out of distributed running counts.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if rows is None:
        rows = largest_group(data, keys)
    if fits_window(df, rows):
        fractions = F.array(*[F.lit(float(p)) for p in probs.values()])
        packed = data.groupBy(*keys).agg(F.percentile("_v", fractions).alias("_q"))
        return packed.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    counted = data.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranked = prefix_totals(
        counted, keys, [F.col("_v").asc()], sums={"_hi": F.col("_n")}, totals={"_all": F.col("_n")}, rows=rows
    ).withColumn("_lo", F.col("_hi") - F.col("_n"))
    picks = []
    for name, p in probs.items():
        place = (F.col("_all") - 1) * F.lit(float(p))
        for suffix, at in (("a", F.floor(place)), ("b", F.ceil(place))):
            hit = (F.col("_lo") <= at) & (at < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{suffix}"))
    agg = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
    out = []
    for name, p in probs.items():
        place = (F.col("_all") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        low, high = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out.append((low * (1 - part) + high * part).alias(name))
    return agg.select(*keys, *out)
