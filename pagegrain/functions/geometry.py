"""Column functions over box coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How recognisers see crops, and how tall one text line may drift.
CROP_X_SCALE = 0.7
CROP_PADDING = 5
LINE_TOLERANCE = 15
EMPTY_REGION_TEXT = "[Bitte manuell prüfen - keine Unterboxen erkannt]"

CORNERS = ("x1", "y1", "x2", "y2")


def has_corners() -> Column:
    return F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()


def with_corners(boxes: DataFrame, array: str = "bbox_pixel") -> DataFrame:
    """Add x1, y1, x2, y2 from a 4-element array; any other length gives nulls."""
    ok = F.size(array) == 4
    return boxes.withColumns(
        {c: F.when(ok, F.col(array)[i]) for i, c in enumerate(CORNERS)}
    )


def line_of(y1: Column, tolerance: int = LINE_TOLERANCE) -> Column:
    """Text line of a box: its top edge rounded down to the tolerance."""
    if tolerance <= 0:
        return y1.cast("long")
    return (F.floor(y1 / tolerance) * tolerance).cast("long")


def band(v: Column, height: int) -> Column:
    return F.floor(v / height).cast("long")


def relative_box(width: Column, height: Column) -> list[Column]:
    """corners as shares of the image size; null without a size."""
    ok = (width > 0) & (height > 0)
    sides = (width, height, width, height)
    return [
        F.when(ok, F.col(c) / s).alias(f"rel_{c}") for c, s in zip(CORNERS, sides, strict=True)
    ]


def crop_bounds(width: Column | int, height: Column | int, padding: int = CROP_PADDING) -> dict[str, Column]:
    """Crop rectangle of a box: x scaled and truncated, ordered, padded, clipped."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    left, right = (
        (F.col(c) * F.lit(CROP_X_SCALE)).cast("long") for c in ("x1", "x2")
    )
    top, bottom = F.col("y1"), F.col("y2")
    return {
        "cx1": F.greatest(F.lit(0), F.least(left, right) - padding),
        "cy1": F.greatest(F.lit(0), F.least(top, bottom) - padding),
        "cx2": F.least(w, F.greatest(left, right) + padding),
        "cy2": F.least(h, F.greatest(top, bottom) + padding),
    }


def clip_box(width: Column | int, height: Column | int) -> dict[str, Column]:
    """keep a box within the image, at least one pixel wide and high.

    An edge up to ten pixels outside counts as on the border; the minimum size
    is applied last, so the result never leaves the image.
    """
    out: dict[str, Column] = {}
    for low, high, size in (("x1", "x2", width), ("y1", "y2", height)):
        side = F.lit(size) if isinstance(size, int) else size
        first = F.greatest(F.lit(0), F.least(F.col(low), side - 1))
        out[low] = first
        out[high] = F.greatest(first + 1, F.least(F.greatest(F.col(low) + 1, F.col(high)), side))
    return {c: out[c] for c in CORNERS}
