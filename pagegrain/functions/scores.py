"""Column functions that turn metrics into bands, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Density bands and the good range of ink per character.
GREEN = (3.5, 6.0)
ORANGE = (2.0, 10.0)
INK_RANGE = (18.0, 35.0)
WEIGHTS = (0.4, 0.2, 0.4)


def round_even(c: Column, digits: int) -> Column:
    """Round half to even, as the archive's own numbers are rounded."""
    scale = 10.0**digits
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def density_band(d: Column) -> Column:
    """green, orange or red by characters per 1000 px."""
    return (
        F.when(d.between(*GREEN), "green").when(d.between(*ORANGE), "orange").otherwise("red")
    )


def unit_range(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def ink_score(v: Column, low: float = INK_RANGE[0], high: float = INK_RANGE[1]) -> Column:
    """1 inside the range, rising to it from 0, falling to 0 at 1.5 x the upper bound."""
    end = high * 1.5
    below = F.lit(1.0) if low <= 0 else unit_range(v / low)
    return (
        F.when(v.isNull(), 0.0)
        .when(v.between(low, high), 1.0)
        .when(v < low, below)
        .when(v >= end, 0.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (v - high) / (end - high)))
    )


def combined_score(metric: Column, confusion: Column, confidence: Column) -> Column:
    """weighted score of ink, text and model confidence, clamped to 0..1."""
    a, b, c = WEIGHTS
    return unit_range(
        a * unit_range(metric) + b * (1.0 - unit_range(confusion)) + c * unit_range(confidence)
    )


def auto_confirm(
    confidence: Column,
    flag: Column,
    ink: Column,
    threshold: float,
    ink_low: float | None = None,
    ink_high: float | None = None,
) -> Column:
    """confident, flagged, and ink (when known and bounded) within its bounds."""
    ok = (confidence >= threshold) & flag
    if ink_low is not None and ink_high is not None:
        ok = ok & (ink.isNull() | ink.between(ink_low, ink_high))
    return F.coalesce(ok, F.lit(False))
