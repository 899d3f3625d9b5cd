"""Deterministic order keys, uniforms and spatial ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds of the background draws: base + step * realization (fixed values).
BASE_SEED = 2025
SEED_STEP = 1009


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def order_key(seed, purpose: str, *ids) -> Column:
    """32 hex digits that shuffle rows the same way on every cluster."""
    parts = [as_col(seed).cast("string"), F.lit(purpose)]
    parts += [as_col(i).cast("string") for i in ids]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed, purpose: str, *ids) -> Column:
    """A double in [0, 1) from the first 52 bits of the order key."""
    head = F.substring(order_key(seed, purpose, *ids), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**52))


def realization_seed(realization) -> Column:
    return F.lit(BASE_SEED) + F.lit(SEED_STEP) * as_col(realization).cast("bigint")


def cell_id(x, y, size, origin_x=0.0, origin_y=0.0, offset_x=0.0, offset_y=0.0) -> Column:
    """Signed grid indices packed into one BIGINT: ix in the high, iy in the low 32 bits."""
    ix = F.floor((as_col(x) - as_col(origin_x) + as_col(offset_x)) / as_col(size)).cast("bigint")
    iy = F.floor((as_col(y) - as_col(origin_y) + as_col(offset_y)) / as_col(size)).cast("bigint")
    low = iy.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.shiftleft(ix, 32).bitwiseXOR(low)


def block_id(x, y, grid: int, min_x, min_y, max_x, max_y) -> Column:
    """x-major block number on a grid x grid partition of the bounds.

    A coordinate outside the bounds (beyond 16 ulp of the upper one) is an error.
    """
    if grid < 2:
        raise ValueError("the block grid needs at least two cells per side")

    def axis(v, lo, hi):
        v, lo, hi = as_col(v), as_col(lo), as_col(hi)
        span = F.greatest(hi - lo, F.lit(1e-12))
        eps = F.greatest(F.abs(hi), F.lit(1.0)) * F.lit(16 * 2.0**-52)
        raw = F.floor((v - lo) / span * F.lit(float(grid))).cast("bigint")
        clipped = F.greatest(F.lit(0), F.least(F.lit(grid - 1), raw)).cast("bigint")
        outside = (v < lo - eps) | (v > hi + eps)
        return F.when(outside, F.raise_error(F.lit("coordinate outside the block bounds")).cast("bigint")).otherwise(clipped)

    return axis(x, min_x, max_x) * F.lit(grid) + axis(y, min_y, max_y)


def point_key(x, y) -> Column:
    """Coordinates at three decimals (half-even), joined by a pipe."""
    def part(v):
        return F.bround(as_col(v), 3).cast("decimal(20,3)").cast("string")

    return F.concat_ws("|", part(x), part(y))
