"""Operators on text boxes.

A box row has ``page_id``, ``box_index``, corners ``x1 y1 x2 y2`` in pixels
(null when unknown), ``text``, ``box_type`` and ``review_status``; reviewed
text, a persistent-region flag and stored metric columns are optional.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import geometry as G
from pagegrain.functions import text as T
from pagegrain.functions.scores import round_even
from pagegrain.operators import spread

BOX = ("page_id", "box_index")


def _text(df: DataFrame) -> Column:
    return T.effective_text("text", "reviewed_text" if "reviewed_text" in df.columns else None)


def char_count(df: DataFrame) -> Column:
    """Characters of the effective text."""
    return F.length(_text(df)).cast("long")


# --- metrics -----------------------------------------------------------------


def with_box_metrics(boxes: DataFrame, image_width: Column | int | None) -> DataFrame:
    """character count, area, position shares of the page width, density.

    Missing corners count as 0 for the area; density is null without area or
    characters; shares are null without an image width.
    """
    width = F.lit(None).cast("long") if image_width is None else (
        F.lit(image_width) if isinstance(image_width, int) else image_width
    )
    x1, y1, x2, y2 = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in G.CORNERS)
    wide = F.greatest(F.lit(0), x2 - x1)
    area = wide * F.greatest(F.lit(0), y2 - y1)
    chars = char_count(boxes)

    def share(v: Column) -> Column:
        return F.when(width > 0, round_even(v / width * 100, 2))

    return boxes.withColumns(
        {
            "char_count": chars,
            "area_px": area,
            "left_pct": share(x1),
            "right_pct": share(x2),
            "width_pct": share(wide),
            "chars_per_1k_px": F.when(
                (area > 0) & (chars > 0), round_even(F.lit(1000) * chars / area, 2)
            ),
        }
    )


def density_per_1k_px(boxes: DataFrame) -> Column:
    """unrounded characters per 1000 px; an empty area counts as 1 px."""
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return F.lit(1000) * F.length(_text(boxes)) / F.greatest(area, F.lit(1))


def box_kind() -> Column:
    """persistent_region, note or normal."""
    return (
        F.when(F.coalesce(F.col("persistent"), F.lit(False)), "persistent_region")
        .when(F.col("box_type") == "note", "note")
        .otherwise("normal")
    )


# --- selections --------------------------------------------------------------

_RANGES = {
    "chars_per_1k_px": ("min_chars_per_1k_px", "max_chars_per_1k_px"),
    "black_pixels": ("min_black_pixels", "max_black_pixels"),
    "black_pixels_per_char": ("min_black_pixels_per_char", "max_black_pixels_per_char"),
}
_POSITIONS = {
    "max_left_pct": ("left_pct", "<="),
    "min_right_pct": ("right_pct", ">="),
    "min_width_pct": ("width_pct", ">="),
    "max_width_pct": ("width_pct", "<="),
}


def _contains(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.strip().lower()))


def _metric_bounds(bounds: dict, stored_chars: Column) -> list[Column]:
    out = []
    for column, (low, high) in _RANGES.items():
        if bounds.get(low) is not None:
            out.append(F.col(column) >= bounds[low])
        if bounds.get(high) is not None:
            out.append(F.col(column) <= bounds[high])
    if bounds.get("min_char_count") is not None:
        out.append(stored_chars >= bounds["min_char_count"])
    if bounds.get("max_char_count") is not None:
        out.append(stored_chars <= bounds["max_char_count"])
    return out


def _positions(bounds: dict, nulls_pass: bool) -> list[Column]:
    out = []
    for key, (column, op) in _POSITIONS.items():
        if bounds.get(key) is None:
            continue
        c = F.col(column) <= bounds[key] if op == "<=" else F.col(column) >= bounds[key]
        out.append(F.col(column).isNull() | c if nulls_pass else c)
    return out


def _all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def filter_boxes(boxes: DataFrame, **bounds) -> DataFrame:
    """Conjunction of the given filters on the box table.

    A set filter drops rows whose metric is null.  Status null counts as
    pending.  ``box_type`` takes ``normal`` for ocr; ``persistent_region`` adds
    nothing to the list, so alone it filters no type.
    """
    conditions = []
    if bounds.get("document_id") is not None:
        conditions.append(F.col("document_id") == bounds["document_id"])
    if bounds.get("page_number_min") is not None:
        conditions.append(F.col("page_number") >= bounds["page_number_min"])
    if bounds.get("page_number_max") is not None:
        conditions.append(F.col("page_number") <= bounds["page_number_max"])
    if bounds.get("review_status"):
        status = F.coalesce(F.col("review_status"), F.lit("pending"))
        conditions.append(status.isin(list(bounds["review_status"])))
    types = [
        "ocr" if t == "normal" else t
        for t in bounds.get("box_type") or ()
        if t != "persistent_region"
    ]
    if types:
        conditions.append(F.col("box_type").isin(types))
    if (bounds.get("text_search") or "").strip():
        conditions.append(_contains(F.col("text"), bounds["text_search"]))
    chars = F.coalesce(
        F.col("char_count") if "char_count" in boxes.columns else F.lit(None).cast("long"),
        F.length("text").cast("long"),
        F.lit(0),
    )
    conditions += _metric_bounds(bounds, chars)
    conditions += _positions(bounds, nulls_pass=False)
    return _all(boxes, conditions)


def lenient_condition(boxes: DataFrame, **bounds) -> Column:
    """P2 as a condition on a row of the box table, never null.

    As P1, but an unknown position passes, text search falls back to the
    stored preview when the text is blank, and types are those of P3.
    Character bounds are applied.
    """
    text = T.strip(_text(boxes))
    conditions = []
    if (bounds.get("text_search") or "").strip():
        shown = (
            F.when(text == "", F.coalesce(T.strip("text_preview"), F.lit(""))).otherwise(text)
            if "text_preview" in boxes.columns
            else text
        )
        conditions.append(_contains(shown, bounds["text_search"]))
    if bounds.get("review_status"):
        status = F.coalesce(F.col("review_status"), F.lit("pending"))
        conditions.append(status.isin(list(bounds["review_status"])))
    if bounds.get("box_type"):
        conditions.append(box_kind().isin(list(bounds["box_type"])))
    conditions += _metric_bounds(bounds, F.length(_text(boxes)).cast("long"))
    conditions += _positions(bounds, nulls_pass=True)
    return reduce(lambda a, c: a & F.coalesce(c, F.lit(False)), conditions, F.lit(True))


def filter_boxes_lenient(boxes: DataFrame, **bounds) -> DataFrame:
    """The selection behind batch edits, see ``lenient_condition``."""
    return boxes.where(lenient_condition(boxes, **bounds))


def box_list(boxes: DataFrame) -> DataFrame:
    """Presentation columns of the box list (needs the page and document columns)."""
    title = F.coalesce(
        F.nullif(F.col("title"), F.lit("")),
        F.nullif(F.col("filename"), F.lit("")),
        F.concat(F.lit("Dokument #"), F.col("document_id").cast("string")),
    )
    return boxes.select(
        F.concat_ws("_", "page_id", "box_index").alias("id"),
        "document_id",
        title.alias("document_title"),
        "page_id",
        "page_number",
        "box_index",
        F.coalesce(F.substring("text", 1, T.PREVIEW_CHARS), F.lit("")).alias("text_preview"),
        F.coalesce(F.col("review_status"), F.lit("pending")).alias("review_status"),
    )


def boxes_to_recognise(boxes: DataFrame) -> DataFrame:
    """Boxes that still wait for recognition."""
    return boxes.where(
        (F.col("review_status") == "new") & (F.col("box_type").isNull() | (F.col("box_type") == "ocr"))
    )


def boxes_of_type(boxes: DataFrame, box_type: str) -> DataFrame:
    """Boxes of one type, ordered within their page."""
    return boxes.where(F.col("box_type") == box_type).orderBy(*BOX)


def page_boxes(boxes: DataFrame, offset: int = 0, limit: int = 200, **bounds) -> DataFrame:
    """One screen of the filtered box list; at most 500 rows per screen."""
    return (
        filter_boxes(boxes, **bounds)
        .orderBy("document_id", "page_number", "page_id", "box_index")
        .offset(offset)
        .limit(min(limit, 500))
    )


def list_boxes(boxes: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Boxes with defaults filled; with ``results``, those of each page's best result."""
    if results is not None:
        boxes = boxes.join(
            best_result(results).select(F.col("id").alias("result_id")), "result_id", "left_semi"
        )
    return boxes.withColumns(
        {
            "review_status": F.coalesce(F.col("review_status"), F.lit("pending")),
            "box_type": F.coalesce(F.col("box_type"), F.lit("ocr")),
            "text": F.coalesce(F.col("text"), F.lit("")),
        }
    )


def inspect_boxes(boxes: DataFrame, sort: str = "stored") -> DataFrame:
    """Boxes with defaults and their place in stored or reading order."""
    filled = list_boxes(boxes)
    if sort == "stored":
        return filled.withColumn("pos", F.col("box_index"))
    return with_reading_order(filled).withColumn("pos", F.col("reading_pos") - 1).drop("reading_pos")


# --- results per page --------------------------------------------------------


def best_result(results: DataFrame) -> DataFrame:
    """Per page the result to show: vision, then native text, then others; newest first."""
    rank = (
        F.when(F.col("source") == "ollama_vision", 2).when(F.col("source") == "pdf_native", 1).otherwise(0)
    )
    usable = results.where(F.col("has_boxes") & F.col("page_id").isNotNull())
    return spread.latest(usable, ["page_id"], [rank, F.col("created_s"), F.col("id")])


def newest_result(results: DataFrame) -> DataFrame:
    """Exactly one result with boxes per page, the newest."""
    usable = results.where(F.col("has_boxes") & F.col("page_id").isNotNull())
    return spread.latest(usable, ["page_id"], [F.col("created_s"), F.col("id")])


def latest_results(results: DataFrame, flag: str = "has_metrics") -> DataFrame:
    """All results at the newest time of their page; ties stay, null pages drop."""
    usable = results.where(F.col(flag) & F.col("page_id").isNotNull())
    newest = usable.groupBy("page_id").agg(F.max("created_s").alias("created_s"))
    return usable.join(newest, ["page_id", "created_s"])


def box_context(boxes: DataFrame, results: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Box -> result -> page -> document, inner joins on their keys.

    ``boxes.result_id``, ``results(id, page_id)``, ``pages(id, document_id,
    page_number)``, ``documents(id, title, filename)``.
    """
    r = results.select(F.col("id").alias("result_id"), "page_id")
    p = pages.select(F.col("id").alias("page_id"), "document_id", "page_number")
    d = documents.select(F.col("id").alias("document_id"), "title", "filename")
    return boxes.join(r, "result_id").join(p, "page_id").join(d, "document_id")


def pages_with_boxes(results: DataFrame, document_id: int | None = None) -> DataFrame:
    """Distinct pages that have a result with boxes."""
    r = results.where("has_boxes")
    if document_id is not None:
        r = r.where(F.col("document_id") == document_id)
    return r.select("page_id").distinct()


def native_page_text(results: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text of the first box of a page's native-text result; blank gives null."""
    native = spread.latest(
        results.where(F.col("source") == "pdf_native"), ["page_id"], [F.col("created_s"), F.col("id")]
    ).select("page_id", F.col("id").alias("result_id"))
    first = boxes.where(F.col("box_index") == 0).select("page_id", "text")
    return native.join(first, "page_id", "left").select(
        "page_id", "result_id", F.nullif(T.strip("text"), F.lit("")).alias("native_text")
    )


# --- order -------------------------------------------------------------------


def with_box_index(rows: DataFrame, key: str = "result_id", order: str = "id") -> DataFrame:
    """0-based number of a box within its result, by id."""
    return spread.row_numbers(rows, [key], [F.col(order)], "box_index", start=0)


def _reading_keys(tolerance: int) -> tuple[Column, Column, list[str]]:
    valid = G.has_corners()
    line = G.line_of(F.col("y1"), tolerance)
    stripe = max(tolerance, 1) * 64
    bucket = F.when(valid, G.band(line, stripe)).otherwise(
        F.lit(1 << 40) + spread.int_bucket("box_index")
    )
    return line, bucket, ["_late", "_line", "x1", "y1", "box_index"]


def _with_reading_keys(boxes: DataFrame, tolerance: int) -> tuple[DataFrame, Column, list[str]]:
    line, bucket, order = _reading_keys(tolerance)
    valid = G.has_corners()
    keyed = boxes.withColumns(
        {
            "_late": ~valid,
            "_line": F.when(valid, line),
        }
    )
    return keyed, bucket, order


def with_reading_order(boxes: DataFrame, tolerance: int = G.LINE_TOLERANCE, name: str = "reading_pos") -> DataFrame:
    """1-based reading position per page: by line, then x, then y, then index.

    Boxes without four corners come last, in stored order.
    """
    keyed, _, _ = _with_reading_keys(boxes, tolerance)
    cols = [
        F.col("_late"),
        F.col("_line"),
        F.when(~F.col("_late"), F.col("x1")),
        F.when(~F.col("_late"), F.col("y1")),
        F.col("box_index"),
    ]
    return spread.row_numbers(keyed, ["page_id"], cols, name).drop("_late", "_line")


def neighbour_context(boxes: DataFrame, tolerance: int = G.LINE_TOLERANCE, short: int = 100) -> DataFrame:
    """Texts of the 2 boxes before and after a box in reading order.

    Blank texts are skipped; when both sides together are shorter than
    ``short`` characters, 4 boxes on each side are taken.
    """
    ordered = with_reading_order(boxes, tolerance).select(
        *BOX, "reading_pos", T.strip(_text(boxes)).alias("_t")
    )
    near = spread.with_neighbours(ordered, ["page_id"], "reading_pos", reach=4)
    w = Window.partitionBy("page_id", "_bucket").orderBy("reading_pos")
    said = F.when(F.col("_t") != "", F.col("_t"))

    def span(a: int, b: int) -> Column:
        return F.array_join(F.collect_list(said).over(w.rowsBetween(a, b)), "\n")

    wide = near.select(
        *BOX,
        "reading_pos",
        "_own",
        span(-2, -1).alias("_b2"),
        span(1, 2).alias("_a2"),
        span(-4, -1).alias("_b4"),
        span(1, 4).alias("_a4"),
    ).where("_own")
    small = F.length("_b2") + F.length("_a2") < short
    return wide.select(
        *BOX,
        "reading_pos",
        F.when(small, F.col("_b4")).otherwise(F.col("_b2")).alias("context_before"),
        F.when(small, F.col("_a4")).otherwise(F.col("_a2")).alias("context_after"),
    )


def full_page_context(boxes: DataFrame, tolerance: int = G.LINE_TOLERANCE) -> DataFrame:
    """W3 over the whole page, as offsets into the page's context text.

    ``before_chars`` characters of the page's joined text (non-blank box texts
    in reading order, newline between) precede the box; the rest after
    ``after_from`` follows it.  Offsets keep the output linear in the boxes.
    """
    ordered = with_reading_order(boxes, tolerance).select(
        *BOX, "reading_pos", F.length(T.strip(_text(boxes))).cast("long").alias("_n")
    )
    step = F.when(F.col("_n") > 0, F.col("_n") + 1).otherwise(F.lit(0))
    summed = spread.running(ordered, ["page_id"], "reading_pos", step, "_sum", "sum")
    start = F.coalesce(F.col("_sum"), F.lit(0))
    return summed.select(
        *BOX,
        "reading_pos",
        F.greatest(start - 1, F.lit(0)).alias("before_chars"),
        (start + step).alias("after_from"),
    )


def page_context_text(boxes: DataFrame, tolerance: int = G.LINE_TOLERANCE) -> DataFrame:
    """The page text that the offsets of ``full_page_context`` point into."""
    said = boxes.withColumn("_said", T.strip(_text(boxes))).where(F.col("_said") != "")
    return _page_join(said, tolerance)


def _page_join(said: DataFrame, tolerance: int) -> DataFrame:
    keyed, bucket, order = _with_reading_keys(said, tolerance)
    return spread.ordered_concat(keyed, ["page_id"], order, bucket, "_said", "\n")


def page_text(boxes: DataFrame, tolerance: int = G.LINE_TOLERANCE) -> DataFrame:
    """Text of each page in reading order, without notes, ignored areas and placeholders."""
    said = boxes.withColumn("_said", T.strip(_text(boxes))).where(
        T.is_page_text(F.col("_said"), F.col("box_type"))
    )
    return _page_join(said, tolerance)


def unit_text(unit_pages: DataFrame, page_texts: DataFrame, sep: str = "\n\n") -> DataFrame:
    """Text of each unit: its pages in order; a page without text is an empty part.

    ``unit_pages(unit_id, pos, page_id)``, ``page_texts(page_id, text)``.
    """
    parts = unit_pages.select("unit_id", "pos", "page_id").join(page_texts, "page_id", "left").withColumn(
        "_part", F.coalesce(F.col("text"), F.lit(""))
    )
    return spread.ordered_concat(
        parts, ["unit_id"], ["pos"], spread.int_bucket("pos", 256), "_part", sep
    )


# --- writing -----------------------------------------------------------------


def replace_boxes(stored: DataFrame, fresh: DataFrame, image_width: Column | int | None) -> DataFrame:
    """The box table after writing the full box lists of some pages.

    Old rows of those pages go; new rows get metrics and defaults.
    """
    keys = fresh.select("page_id").distinct()
    ready = with_box_metrics(
        fresh.withColumns(
            {
                "box_type": F.coalesce(F.nullif(F.col("box_type"), F.lit("")), F.lit("ocr")),
                "review_status": F.coalesce(
                    F.nullif(F.col("review_status"), F.lit("")), F.lit("pending")
                ),
            }
        ),
        image_width,
    )
    kept = stored.join(keys, "page_id", "left_anti")
    return kept.unionByName(ready, allowMissingColumns=True)


def crop_to_page(
    detected: DataFrame, thousand_scale: bool = True, clip_to_image: bool = False
) -> DataFrame:
    """boxes found in a region crop, moved to page pixels.

    Input: ``region_id, det_index, n1..n4`` (box relative to the crop), ``text``,
    ``crop_w, crop_h``, region corners ``rx1..ry2`` and page size ``page_w, page_h``;
    a region without detections has one row with null ``n1``.  When a right or
    lower edge lies beyond the crop, all four values are read on a 0-1000 scale.
    Regions left without a box give one region-sized box with a marker text.
    """
    cw, ch = F.col("crop_w"), F.col("crop_h")
    raw = {
        "p1": F.col("n1") * cw, "p2": F.col("n2") * ch, "p3": F.col("n3") * cw, "p4": F.col("n4") * ch,
    }
    d = detected.withColumns(raw)
    scaled = F.lit(thousand_scale) & ((F.col("p3") > cw) | (F.col("p4") > ch))

    def px(c: str, size: Column) -> Column:
        v = F.when(scaled, F.col(c) / 1000.0 * size).otherwise(F.col(c))
        return F.greatest(F.lit(0.0), F.least(v, size.cast("double"))).cast("long")

    d = d.withColumns({"q1": px("p1", cw), "q2": px("p2", ch)})
    least_size = F.when(scaled, F.lit(0)).otherwise(F.lit(1))
    d = d.withColumns(
        {
            "q3": F.when(scaled, px("p3", cw)).otherwise(F.greatest(F.col("q1") + least_size, px("p3", cw))),
            "q4": F.when(scaled, px("p4", ch)).otherwise(F.greatest(F.col("q2") + least_size, px("p4", ch))),
        }
    )
    d = d.withColumns(
        {
            "x1": F.greatest(F.col("rx1"), (F.col("rx1") + F.col("q1") / G.CROP_X_SCALE).cast("long")),
            "y1": F.greatest(F.col("ry1"), F.col("ry1") + F.col("q2")),
            "x2": F.least(F.col("rx2"), (F.col("rx1") + F.col("q3") / G.CROP_X_SCALE).cast("long")),
            "y2": F.least(F.col("ry2"), F.col("ry1") + F.col("q4")),
            "text": T.strip("text"),
        }
    )
    if clip_to_image:
        d = d.withColumns(
            {"x2": F.least("x2", "page_w"), "y2": F.least("y2", "page_h")}
        )
    sized = (cw > 0) & (ch > 0) & (F.col("rx2") > F.col("rx1")) & (F.col("ry2") > F.col("ry1"))
    good = (
        sized
        & F.col("n1").isNotNull()
        & (F.col("x2") > F.col("x1"))
        & (F.col("y2") > F.col("y1"))
        & (F.col("text") != "")
    )
    out = ["region_id", "det_index", "text", *G.CORNERS]
    found = d.where(good).select(*out)
    regions = d.groupBy("region_id").agg(
        F.max(F.coalesce(good, F.lit(False))).alias("_any"),
        *[F.first(c).alias(c) for c in ("rx1", "ry1", "rx2", "ry2", "page_w", "page_h")],
    )
    empty = regions.where(~F.col("_any") & (F.col("page_w") > 0) & (F.col("page_h") > 0)).select(
        "region_id",
        F.lit(0).cast(detected.schema["det_index"].dataType).alias("det_index"),
        F.lit(G.EMPTY_REGION_TEXT).alias("text"),
        F.col("rx1").alias("x1"),
        F.col("ry1").alias("y1"),
        F.col("rx2").alias("x2"),
        F.col("ry2").alias("y2"),
    )
    return found.unionByName(empty)


def recrop_to_page(detected: DataFrame, scale: float, x_stretch: float = 1 / 0.7) -> DataFrame:
    """boxes found in a re-rendered crop, moved to page pixels, at least 1 px in size."""
    cw, ch = F.col("crop_w"), F.col("crop_h")
    d = detected.withColumn("text", T.strip("text")).where(
        (F.col("text") != "") & (F.col("n3") > F.col("n1")) & (F.col("n4") > F.col("n2"))
    )

    def low(c: str, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least((F.col(c) * size).cast("long"), size))

    d = d.withColumns({"q1": low("n1", cw), "q2": low("n2", ch)})
    d = d.withColumns(
        {
            "q3": F.greatest(F.col("q1") + 1, F.least((F.col("n3") * cw).cast("long"), cw)),
            "q4": F.greatest(F.col("q2") + 1, F.least((F.col("n4") * ch).cast("long"), ch)),
        }
    )

    def page(origin: str, q: str, stretch: float) -> Column:
        return (F.col(origin) + F.col(q) * F.lit(stretch) / F.lit(scale)).cast("long")

    d = d.withColumns({"x1": page("rx1", "q1", x_stretch), "y1": page("ry1", "q2", 1.0)})
    return d.select(
        "region_id",
        "det_index",
        "text",
        "x1",
        "y1",
        F.greatest(F.col("x1") + 1, page("rx1", "q3", x_stretch)).alias("x2"),
        F.greatest(F.col("y1") + 1, page("ry1", "q4", 1.0)).alias("y2"),
    )
