"""Numeric rules shared by every operator, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Round half towards +infinity: -2.5 becomes -2."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def byte(c: Column) -> Column:
    """Store into an 8-bit cell: half to even, clamped to 0..255."""
    return clamp(F.bround(c), 0.0, 255.0).cast("int")


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def upper_median(col: str) -> Column:
    """``sorted[n >> 1]``: the greater of the two middle values when n is even.

    ``percentile_disc`` gives the lesser one, so it is asked about the negated values. Counts per
    value are combined map-side.
    """
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{col})")


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter interval; 0 for a degenerate interval."""
    shorter = F.least(a1 - a0, b1 - b0)
    shared = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(shorter <= 0, F.lit(0.0)).otherwise(shared.cast("double") / shorter)
