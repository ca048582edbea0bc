"""Operators on dark pixels: coverage by boxes, ink per box and per region.

``dark`` has one row per dark pixel of a page image: ``page_id, x, y``.  Pixels are gathered into words of 64 (one
number per run of columns in an image row) and the words into small image tiles; a tile is one row of at most 128
words.  Boxes meet tiles, not pixels: what a box holds of a tile are set bits under its mask, and what all boxes
cover of it is the union of their masks.  So rows after a join grow with boxes and tiles, never with boxes times
pixels, and one page with very many pixels is spread over many tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import geometry as G
from pagegrain.operators.boxes import char_count

TILE_W = 256
TILE_H = 32
REGION_BAND = 256
#: Columns of a word.
WORD = 64
_TILE = ["page_id", "_tx", "_ty"]


def _words(dark: DataFrame) -> DataFrame:
    """Dark pixels as words: ``_w`` numbers the runs of 64 columns, ``bits`` has a bit per dark pixel of a run."""
    x = F.col("x").cast("long")
    return (
        dark.select(
            "page_id",
            G.band(F.col("x"), TILE_W).alias("_tx"),
            G.band(F.col("y"), TILE_H).alias("_ty"),
            F.col("y").cast("long").alias("_y"),
            F.floor(x / WORD).alias("_w"),
            F.expr(f"shiftleft(1L, int(pmod(cast(x AS BIGINT), {WORD})))").alias("_bit"),
        )
        .groupBy(*_TILE, "_y", "_w")
        .agg(F.bit_or("_bit").alias("bits"))
    )


def _tiles(dark: DataFrame) -> DataFrame:
    """One row per tile with a dark pixel: its words, 128 at most."""
    return _words(dark).groupBy(*_TILE).agg(F.collect_list(F.struct("_y", "_w", "bits")).alias("words"))


#: Bits of word ``p`` that lie inside the rectangle l,t,r,b.
_MASKED = f"""if(p._y < t or p._y >= b or r <= p._w * {WORD} or l >= (p._w + 1) * {WORD} or l >= r, 0L,
  p.bits & shiftleft(shiftrightunsigned(-1L, int({WORD} - (least(r - p._w * {WORD}, {WORD}) - greatest(l - p._w * {WORD}, 0L)))),
    int(greatest(l - p._w * {WORD}, 0L))))"""


def _covered(rects: DataFrame, dark: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words (keys, tile, ``_y``, ``_w``) with the dark pixels that some rectangle of the keys covers."""
    cut = _distinct_per_tile(_explode_tiles(rects), keys)
    met = cut.join(_tiles(dark), _TILE).select(
        *keys, "_tx", "_ty", F.explode(F.expr(f"filter(transform(words, p -> struct(p._y AS _y, p._w AS _w, {_MASKED} AS bits)), q -> q.bits <> 0)")).alias("_p")
    )
    return met.groupBy(*keys, "_tx", "_ty", F.col("_p._y").alias("_y"), F.col("_p._w").alias("_w")).agg(F.bit_or("_p.bits").alias("covered"))


def _explode_tiles(rects: DataFrame) -> DataFrame:
    """One row per tile that the half-open rectangle l,t,r,b touches; empty ones vanish."""
    rects = rects.where((F.col("l") < F.col("r")) & (F.col("t") < F.col("b")))
    rects = rects.withColumn(
        "_tx", F.explode(F.sequence(G.band(F.col("l"), TILE_W), G.band(F.col("r") - 1, TILE_W)))
    )
    return rects.withColumn(
        "_ty", F.explode(F.sequence(G.band(F.col("t"), TILE_H), G.band(F.col("b") - 1, TILE_H)))
    )


def _clip(v: Column, low: Column | int, high: Column | int) -> Column:
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return F.greatest(lo, F.least(v, hi)).cast("long")


def _page_rects(boxes: DataFrame, width: int, height: int, keys: Sequence[str]) -> DataFrame:
    return boxes.where(G.has_corners()).select(
        *keys,
        _clip(F.col("x1"), 0, width).alias("l"),
        _clip(F.col("y1"), 0, height).alias("t"),
        _clip(F.col("x2"), 0, width).alias("r"),
        _clip(F.col("y2"), 0, height).alias("b"),
    )


def _distinct_per_tile(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cut rectangles to their tiles and drop the copies this leaves."""
    left, top = F.col("_tx") * TILE_W, F.col("_ty") * TILE_H
    return rects.select(
        *keys,
        "_tx",
        "_ty",
        F.greatest(F.col("l"), left).alias("l"),
        F.greatest(F.col("t"), top).alias("t"),
        F.least(F.col("r"), left + TILE_W).alias("r"),
        F.least(F.col("b"), top + TILE_H).alias("b"),
    ).distinct()


def uncovered_pixels(dark: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Dark pixels that no box of their page covers (half-open boxes, clipped to the image)."""
    covered = _covered(_page_rects(boxes, width, height, ["page_id"]), dark, ["page_id"])
    left = _words(dark).join(covered, [*_TILE, "_y", "_w"], "left")
    loose = left.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("covered", F.lit(0).cast("long")))))
    places = F.expr(f"filter(sequence(0, {WORD - 1}), k -> (bits & shiftleft(1L, k)) <> 0)")
    rows = loose.where(F.col("bits") != 0).select("page_id", "_w", "_y", F.explode(places).alias("_k"))
    kinds = {f.name: f.dataType for f in dark.schema}
    return rows.select(
        "page_id",
        (F.col("_w") * WORD + F.col("_k")).cast(kinds["x"]).alias("x"),
        F.col("_y").cast(kinds["y"]).alias("y"),
    )


def _ratios(total: Column, uncovered: Column) -> list[Column]:
    return [
        total.alias("total_dark"),
        uncovered.alias("uncovered_dark"),
        F.when(total == 0, F.lit(1.0)).otherwise(1 - uncovered / total).alias("coverage"),
        F.when(total == 0, F.lit(0.0)).otherwise(uncovered / total).alias("uncovered"),
    ]


def page_coverage(
    dark: DataFrame, boxes: DataFrame, width: int, height: int, pages: DataFrame | None = None
) -> DataFrame:
    """A4: dark pixels, uncovered dark pixels and their ratios per page.

    Pages without a dark pixel are fully covered; they appear when ``pages``
    (a frame with ``page_id``) lists them.
    """
    total = _tiles(dark).groupBy("page_id").agg(F.sum(_dark_of("words")).alias("_t"))
    met = _covered(_page_rects(boxes, width, height, ["page_id"]), dark, ["page_id"])
    met = met.groupBy("page_id").agg(F.sum(F.bit_count("covered").cast("long")).alias("_c"))
    if pages is not None:
        total = pages.select("page_id").distinct().join(total, "page_id", "left")
    t, c = F.coalesce(F.col("_t"), F.lit(0)), F.coalesce(F.col("_c"), F.lit(0))
    return total.join(met, "page_id", "left").select("page_id", *_ratios(t, t - c))


def _dark_of(words: str, bits: str = "p.bits") -> Column:
    """Number of dark pixels in an array of words."""
    return F.expr(f"aggregate({words}, 0L, (n, p) -> n + bit_count({bits}))")


def box_black_pixels(
    boxes: DataFrame, dark: DataFrame, width: int, height: int, padding: int = G.CROP_PADDING
) -> DataFrame:
    """Dark pixels in the crop of each box, and per character.

    Boxes without corners or with a crop that lies outside the image give no row.
    """
    keys = ["page_id", "box_index"]
    crops = (
        boxes.where(G.has_corners())
        .withColumns(G.crop_bounds(width, height, padding))
        .where((F.col("cx1") <= F.col("cx2")) & (F.col("cy1") <= F.col("cy2")))
        .select(
            *keys,
            char_count(boxes).alias("char_count"),
            *[F.col(c).cast("long").alias(k) for k, c in zip("ltrb", ("cx1", "cy1", "cx2", "cy2"), strict=True)],
        )
    )
    return _count_pixels(crops, dark, keys)


def page_black_px(box_ink: DataFrame) -> DataFrame:
    """A2: least and greatest ink per character of a page, over boxes with characters."""
    v = F.col("black_pixels_per_char")
    return box_ink.groupBy("page_id").agg(
        F.min(v).alias("min_black_px"),
        F.max(v).alias("max_black_px"),
        F.count(v).alias("boxes_with_chars"),
    )


def _count_pixels(rects: DataFrame, dark: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dark pixels per rectangle (key, char_count, l..b), rectangles without any included.

    One row per rectangle and tile and a zero row per rectangle go through one aggregate with map-side combine, so no
    join back to the rectangles is needed.
    """
    hits = _explode_tiles(rects).join(_tiles(dark), _TILE).select(*keys, "char_count", _dark_of("words", _MASKED).alias("_n"))
    zeros = rects.select(*keys, "char_count", F.lit(0).cast("long").alias("_n"))
    black = F.col("black_pixels")
    return (
        zeros.unionByName(hits)
        .groupBy(*keys, "char_count")
        .agg(F.sum("_n").alias("black_pixels"))
        .select(
            *keys,
            "black_pixels",
            "char_count",
            F.when(F.col("char_count") > 0, black / F.col("char_count")).alias("black_pixels_per_char"),
        )
    )


# --- persistent regions --------------------------------------------------------


def regions(boxes: DataFrame) -> DataFrame:
    """Persistent regions with four corners."""
    return boxes.where(F.coalesce(F.col("persistent"), F.lit(False)) & G.has_corners()).select(
        "page_id",
        F.col("box_index").alias("region_index"),
        *[F.col(c).alias(f"r{c}") for c in G.CORNERS],
    )


def region_children(boxes: DataFrame) -> DataFrame:
    """Boxes that lie fully inside a persistent region of their page (closed bounds).

    Ignored areas, notes and other regions are no children.  A child meets a
    region once, in the horizontal band of its own top edge.
    """
    r = regions(boxes).withColumn(
        "_band",
        F.explode(
            F.sequence(
                G.band(F.least("ry1", "ry2"), REGION_BAND), G.band(F.greatest("ry1", "ry2"), REGION_BAND)
            )
        ),
    )
    kind = F.coalesce(F.col("box_type"), F.lit("ocr"))
    c = boxes.where(
        G.has_corners()
        & ~kind.isin("ignore_region", "note")
        & ~F.coalesce(F.col("persistent"), F.lit(False))
    ).withColumn("_band", G.band(F.col("y1"), REGION_BAND))
    return (
        c.join(r, ["page_id", "_band"])
        .where(
            (F.col("x1") >= F.col("rx1"))
            & (F.col("y1") >= F.col("ry1"))
            & (F.col("x2") <= F.col("rx2"))
            & (F.col("y2") <= F.col("ry2"))
            & (F.col("box_index") != F.col("region_index"))
        )
        .drop("_band")
    )


def _clipped_regions(boxes: DataFrame, width: int, height: int) -> DataFrame:
    return regions(boxes).select(
        "page_id",
        "region_index",
        _clip(F.col("rx1"), 0, width).alias("l"),
        _clip(F.col("ry1"), 0, height).alias("t"),
        _clip(F.col("rx2"), 0, width).alias("r"),
        _clip(F.col("ry2"), 0, height).alias("b"),
    )


def _child_rects(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Children cut to their region and the image."""
    inside = region_children(boxes).withColumns(
        {
            "_l": _clip(F.col("rx1"), 0, width),
            "_t": _clip(F.col("ry1"), 0, height),
            "_r": _clip(F.col("rx2"), 0, width),
            "_b": _clip(F.col("ry2"), 0, height),
        }
    )
    return inside.select(
        "page_id",
        "region_index",
        "box_index",
        char_count(boxes).alias("char_count"),
        _clip(F.col("x1"), F.col("_l"), F.col("_r")).alias("l"),
        _clip(F.col("y1"), F.col("_t"), F.col("_b")).alias("t"),
        _clip(F.col("x2"), F.col("_l"), F.col("_r")).alias("r"),
        _clip(F.col("y2"), F.col("_t"), F.col("_b")).alias("b"),
    ).where((F.col("l") < F.col("r")) & (F.col("t") < F.col("b")))


def region_coverage(boxes: DataFrame, dark: DataFrame, width: int, height: int) -> DataFrame:
    """A5: coverage of each persistent region by its children.

    A region that is empty after clipping has coverage 0; one without a dark
    pixel has coverage 1.
    """
    keys = ["page_id", "region_index"]
    area = _clipped_regions(boxes, width, height)
    total = (
        _explode_tiles(area).join(_tiles(dark), _TILE).groupBy(*keys).agg(F.sum(_dark_of("words", _MASKED)).alias("_tot"))
    )
    met = _covered(_child_rects(boxes, width, height), dark, keys)
    met = met.groupBy(*keys).agg(F.sum(F.bit_count("covered").cast("long")).alias("_c"))
    t, c = F.coalesce(F.col("_tot"), F.lit(0)), F.coalesce(F.col("_c"), F.lit(0))
    empty = (F.col("l") >= F.col("r")) | (F.col("t") >= F.col("b"))
    # children are cut to their region, so all that they cover lies in it
    total_dark, loose_dark, coverage, uncovered = _ratios(t, t - c)
    return (
        area.join(total, keys, "left")
        .join(met, keys, "left")
        .select(
            *keys,
            total_dark,
            loose_dark,
            F.when(empty, F.lit(0.0)).otherwise(coverage).alias("coverage"),
            F.when(empty, F.lit(1.0)).otherwise(uncovered).alias("uncovered"),
        )
    )


def region_child_ink(boxes: DataFrame, dark: DataFrame, width: int, height: int) -> DataFrame:
    """A5: dark pixels and ink per character of each child of a region."""
    keys = ["page_id", "region_index", "box_index"]
    return _count_pixels(_child_rects(boxes, width, height), dark, keys)


def region_rollup(boxes: DataFrame, child_ink: DataFrame | None = None) -> DataFrame:
    """Children, their ink and characters per region; sums are null without children."""
    keys = ["page_id", "region_index"]
    kids = region_children(boxes).select(*keys, "box_index", char_count(boxes).alias("_chars"))
    if child_ink is not None:
        kids = kids.join(child_ink.select(*keys, "box_index", "black_pixels"), [*keys, "box_index"], "left")
    else:
        kids = kids.withColumn("black_pixels", F.lit(0).cast("long"))
    sums = kids.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.coalesce(F.col("black_pixels"), F.lit(0))).alias("black_pixels"),
        F.sum("_chars").alias("char_count"),
    )
    return (
        regions(boxes)
        .select(*keys)
        .join(sums, keys, "left")
        .select(
            *keys,
            F.coalesce(F.col("_k"), F.lit(0)).alias("child_count"),
            "black_pixels",
            "char_count",
            F.when(F.col("char_count") > 0, F.col("black_pixels") / F.col("char_count")).alias(
                "black_pixels_per_char"
            ),
        )
    )


def region_list(boxes: DataFrame, dark: DataFrame, width: int, height: int) -> DataFrame:
    """Regions with their roll-up and coverage (the rows that T3 sorts)."""
    keys = ["page_id", "region_index"]
    ink = region_child_ink(boxes, dark, width, height)
    return region_rollup(boxes, ink).join(region_coverage(boxes, dark, width, height), keys)


_SORT = {
    "page": "page_id",
    "document": "document_id",
    "coverage": "coverage",
    "child_count": "child_count",
    "black_pixels_per_char": "black_pixels_per_char",
}


def sort_regions(
    rows: DataFrame,
    by: str = "page",
    descending: bool = False,
    offset: int = 0,
    limit: int | None = None,
    **bounds,
) -> DataFrame:
    """Regions filtered by bounds (nulls drop) and sorted; a null metric sorts as -1."""
    for column, name in (("coverage", "coverage"), ("uncovered", "uncovered"), ("black_pixels_per_char", "px_per_char")):
        if bounds.get(f"min_{name}") is not None:
            rows = rows.where(F.col(column) >= bounds[f"min_{name}"])
        if bounds.get(f"max_{name}") is not None:
            rows = rows.where(F.col(column) <= bounds[f"max_{name}"])
    key = F.coalesce(F.col(_SORT[by]), F.lit(-1))
    rows = rows.orderBy(key.desc() if descending else key.asc(), "page_id", "region_index")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def pages_with_regions(boxes: DataFrame) -> DataFrame:
    """U4: distinct pages with at least one persistent region with corners."""
    return regions(boxes).select("page_id").distinct()


def best_stage(stages: DataFrame, threshold: float = 0.85, most: int = 4) -> DataFrame:
    """Per region the best recognition stage.

    ``stages(region_id, stage, coverage)`` with stages counted from the first.
    Stages count up to the first that reaches the threshold, at most ``most``;
    the best is the greatest coverage, the earliest on ties, never a null one.
    """
    stop = stages.groupBy("region_id").agg(
        F.min("stage").alias("_from"),
        F.min(F.when(F.col("coverage") >= threshold, F.col("stage"))).alias("_stop"),
    )
    used = stages.join(stop, "region_id").where(
        (F.col("stage") < F.col("_from") + most)
        & (F.col("_stop").isNull() | (F.col("stage") <= F.col("_stop")))
    )
    ranked = F.when(F.col("coverage").isNotNull(), F.struct("coverage", -F.col("stage")))
    return used.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("stages_used"),
        F.max_by("stage", ranked).alias("best_stage"),
        F.max("coverage").alias("best_coverage"),
    )
