"""Stratified, thinned and block-balanced background draws for many realizations at once."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.keys import BASE_SEED, SEED_STEP, cell_id, order_key
from stratafold.operators.ordering import largest_group, prefix_totals
from stratafold.session import cut

# Scarce strata choose first so that common ones cannot use up their cells (fixed order).
DRAW_ORDER = ("transition", "background", "hard")
LETTERS = {"hard": "H", "transition": "T", "background": "B"}


def offset_of(seed: int, purpose: str) -> float:
    """The same uniform as functions.keys.uniform, for one driver-side parameter."""
    digits = hashlib.md5(f"{seed}|{purpose}".encode()).hexdigest()[:13]
    return int(digits, 16) / 2**52


def realizations(df: DataFrame, count: int, thinning_cell: float, origin: Sequence[float]) -> DataFrame:
    """Every candidate once per realization, with its seed and thinning cell.

    The realizations are a literal array: no join and no shuffle.
    """
    rows = []
    for i in range(count):
        seed = BASE_SEED + SEED_STEP * i
        rows.append(F.struct(
            F.lit(i).alias("realiz"), F.lit(seed).cast("bigint").alias("seed"),
            F.lit(offset_of(seed, "offset_x") * thinning_cell).alias("_ox"),
            F.lit(offset_of(seed, "offset_y") * thinning_cell).alias("_oy"),
        ))
    out = df.select("*", F.inline(F.array(*rows)))
    thin = cell_id(F.col("x"), F.col("y"), thinning_cell, origin[0], origin[1], F.col("_ox"), F.col("_oy"))
    return out.withColumn("thin_id", thin).drop("_ox", "_oy")


def representatives(pool: DataFrame, row_id: str, purpose: str) -> DataFrame:
    """One random row per (realization, thinning cell), by an aggregate with map-side combine.

    It sorts, since its buffers hold texts: cells come first, as realizations hardly tell rows apart.
    """
    key = order_key(F.col("seed"), f"{purpose}-cell", F.col(row_id))
    return pool.groupBy("thin_id", "realiz", "seed").agg(
        F.min_by(F.struct(row_id, "block_id"), F.struct(key, F.col(row_id))).alias("_r")
    ).select("realiz", "seed", "thin_id", "_r.*")


def balanced_draw(
    pool: DataFrame, quota, row_id: str, purpose: str, *, used: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Rows of ``pool`` chosen per realization: thin, rotate over blocks, take the quota.

    ``quota`` is a number or the name of a pool column constant within a
    realization. Returns (realiz, row_id, thin_id, block_id, pick) with pick
    counting from 1.
    """
    if rows is None:
        rows = largest_group(pool, ["realiz"])
    limit = F.lit(quota) if isinstance(quota, int) else None
    reps = representatives(pool, row_id, purpose)
    if used is not None:  # whole cells go, so one row per cell meets them, not every candidate
        reps = reps.join(used.select("realiz", "thin_id"), ["realiz", "thin_id"], "left_anti")
    if limit is None:
        caps = pool.groupBy("realiz").agg(F.max(quota).alias("_quota"))
        reps = reps.join(F.broadcast(caps), "realiz")  # one row per realization
        limit = F.col("_quota")
    shuffled = reps.withColumn("_perm", order_key(F.col("seed"), f"{purpose}-perm", F.col(row_id)))
    rounds = prefix_totals(
        shuffled, ["realiz", "block_id"], [F.col("_perm").asc(), F.col(row_id).asc()], position="_round", rows=rows
    ).withColumn("_block", order_key(F.col("seed"), f"{purpose}-block", F.col("block_id")))
    placed = prefix_totals(
        rounds, ["realiz"], [F.col("_round").asc(), F.col("_block").asc(), F.col(row_id).asc()], position="pick", rows=rows
    )
    return placed.where(F.col("pick") <= limit).select("realiz", row_id, "thin_id", "block_id", "pick")


def staged_draw(pool: DataFrame, quotas: Mapping[str, int], row_id: str, *, strict: bool = True) -> DataFrame:
    """Draw all strata of all realizations; a thinning cell serves one stratum only.

    Each stage is written once, since the next one excludes its cells. With
    ``strict`` an unmet quota is an error, otherwise what exists is returned.
    """
    rows = largest_group(pool, ["realiz"])
    chosen = used = None
    for name in DRAW_ORDER:
        if quotas[name] == 0:
            continue
        stage = cut(balanced_draw(
            pool.where(F.col("stratum") == name), quotas[name], row_id, name, used=used, rows=rows
        ).withColumn("stratum", F.lit(name)))
        if strict:
            require_quota(pool, stage, name, quotas[name])
        used = stage if used is None else used.unionByName(stage)
        chosen = used
    return chosen


def require_quota(pool: DataFrame, stage: DataFrame, name: str, quota: int) -> None:
    have = pool.select("realiz").distinct().join(stage.groupBy("realiz").count(), "realiz", "left")
    short = have.where(F.coalesce("count", F.lit(0)) < quota).count()
    if short:
        raise ValueError(f"{short} realizations have too few {name} thinning cells for a quota of {quota}")


def uniform_draw(pool: DataFrame, quota: int, row_id: str) -> DataFrame:
    """Quota of thinning cells without strata, one random row per cell."""
    rows = largest_group(pool, ["realiz"])
    reps = representatives(pool, row_id, "uniform").withColumn("_key", order_key(F.col("seed"), "uniform", F.col(row_id)))
    placed = prefix_totals(reps, ["realiz"], [F.col("_key").asc(), F.col(row_id).asc()], position="pick", rows=rows)
    return placed.where(F.col("pick") <= quota).select("realiz", row_id, "thin_id", "block_id", "pick")


def negative_ids(chosen: DataFrame) -> DataFrame:
    """Ids N, realization, stratum letter and the pick counted from 0."""
    letter = F.lit("?")
    for name, sign in LETTERS.items():
        letter = F.when(F.col("stratum") == name, sign).otherwise(letter)
    return chosen.withColumn("sample_id", F.format_string("N%02d%s%06d", F.col("realiz"), letter, F.col("pick") - 1))


def capacity(pool: DataFrame, quotas: Mapping[str, int], keys: Sequence[str] = ("realiz",)) -> DataFrame:
    """Points and distinct thinning cells per stratum against its quota."""
    wanted = F.create_map(*[F.lit(v) for pair in quotas.items() for v in (pair[0], int(pair[1]))])
    agg = pool.groupBy(*keys, "stratum").agg(F.count("*").alias("points"), F.countDistinct("thin_id").alias("thin_cells"))
    need = wanted[F.col("stratum")].cast("bigint")
    return agg.withColumn("quota", need).withColumn("feasible", F.col("thin_cells") >= need)


def replace_training_negatives(
    base: DataFrame, replacements: DataFrame, replaceable, row_id: str = "row_index", prefix: str = "NM"
) -> DataFrame:
    """Swap the rows selected by ``replaceable`` for new samples, position by position; all others stay as they are.

    ``replacements`` needs ``pick`` counting from 1; the two sides meet by an
    equi join on the position. A slot without replacement, a replacement
    without slot or a position given twice is an error.
    """
    keep = base.where(~replaceable)
    slots = prefix_totals(base.where(replaceable).select(row_id), [], [F.col(row_id).asc()], position="pick")
    pairs = slots.select("pick", F.lit(1).alias("_slot")).join(
        replacements.groupBy("pick").agg(F.count("*").alias("_given")), "pick", "full_outer")
    odd = pairs.where(F.col("_slot").isNull() | F.col("_given").isNull() | (F.col("_given") > 1)).count()
    if odd:
        raise ValueError(f"{odd} positions do not have one slot and one replacement each")
    new = replacements.join(slots, "pick").withColumn("sample_id", F.format_string(f"{prefix}%08d", F.col("pick") - 1)).drop("pick")
    return keep.unionByName(new.select(*base.columns))
