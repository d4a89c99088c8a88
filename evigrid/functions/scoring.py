"""Exposure scores: bands of single indicators, weighted sub-indices, the composite and its tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges and the values of the bands.
LOW_IS_BAD = {"hand": ((1, 1.0), (3, 0.66), (10, 0.33)), "percentile": ((10, 1.0), (25, 0.66), (50, 0.33))}
HIGH_IS_BAD = {"twi": ((12, 1.0), (10, 0.66), (8, 0.33)), "relief": ((8, 1.0), (4, 0.66), (2, 0.33)), "complaints": ((10, 1.0), (3, 0.66), (1, 0.33))}
TIER_CUTS = ((1.5, 1), (1.0, 2), (0.5, 3), (0.01, 4))


def band(kind: str, value: Column) -> Column:
    """The value of an indicator's band from 0 to 1; 0 for a missing value."""
    out = F.when(value.isNull(), 0.0)
    for edge, score in LOW_IS_BAD.get(kind, ()):
        out = out.when(value < edge, score)
    for edge, score in HIGH_IS_BAD.get(kind, ()):
        out = out.when(value >= edge, score)
    return out.otherwise(0.0)


def sub_index(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of indicators; missing ones count as 0."""
    total = sum(w for _, w in parts)
    return sum((F.coalesce(c.cast("double"), F.lit(0.0)) * F.lit(w) for c, w in parts), F.lit(0.0)) / F.lit(total)


def tier(score: Column, floored: Column | None = None) -> Column:
    """Tier 1 (highest) to 4, or 0; where `floored` holds, 2 at least."""
    out = F.when(F.lit(False), 0)
    for cut, value in TIER_CUTS:
        out = out.when(score >= cut, value)
    out = out.otherwise(0)
    return out if floored is None else F.when(floored & ((out == 0) | (out > 2)), 2).otherwise(out)
