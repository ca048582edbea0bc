"""Page-level quality: text density, review progress, angles, the page quality table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import geometry as G
from pagegrain.functions.scores import round_even
from pagegrain.operators import boxes as B
from pagegrain.operators import ink, spread

# Review states that count as reviewed.
REVIEWED = ("confirmed", "rejected", "auto_confirmed")


def _with_density(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("_d", F.when(G.has_corners(), B.density_per_1k_px(boxes)))


def _density_sums() -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(F.min("_d"), zero).alias("min_density"),
        F.coalesce(F.max("_d"), zero).alias("max_density"),
        F.count("_d").alias("box_count"),
    ]


def _review_sums() -> list[Column]:
    counts = F.coalesce(F.col("box_type"), F.lit("ocr")) != "note"
    done = F.coalesce(counts & F.col("review_status").isin(*REVIEWED), F.lit(False))
    total = F.count_if(counts)
    share = round_even(F.lit(100.0) * F.count_if(done) / total, 1)
    return [
        total.alias("countable_boxes"),
        F.when(total > 0, share).otherwise(F.lit(0.0)).alias("reviewed_pct"),
    ]


def _with_median(per_page: DataFrame, rows: DataFrame) -> DataFrame:
    middle = spread.exact_median(rows, ["page_id"], "_d", "_median")
    return per_page.join(middle, "page_id", "left").withColumn(
        "median_density", F.coalesce(F.col("_median"), F.lit(0.0))
    ).drop("_median")


def page_density(boxes: DataFrame) -> DataFrame:
    """A1: exact median, min and max of characters per 1000 px and the number of valid boxes."""
    rows = _with_density(boxes)
    per_page = rows.groupBy("page_id").agg(*_density_sums())
    return _with_median(per_page, rows).select(
        "page_id", "median_density", "min_density", "max_density", "box_count"
    )


def reviewed_pct(boxes: DataFrame) -> DataFrame:
    """A3: share of reviewed boxes among those that are not notes, in percent."""
    return boxes.groupBy("page_id").agg(*_review_sums())


def density_and_review(boxes: DataFrame) -> DataFrame:
    """A1 and A3 of each page from one pass over the boxes (and one for the median)."""
    rows = _with_density(boxes)
    return _with_median(rows.groupBy("page_id").agg(*_density_sums(), *_review_sums()), rows)


def confirmed_pages(boxes: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Pages whose relevant boxes are confirmed to at least ``ratio``.

    ``boxes`` are those of each page's newest result.  Notes and ignored areas
    are not relevant; a page with only such boxes qualifies.
    """
    relevant = ~F.coalesce(F.col("box_type"), F.lit("ocr")).isin("note", "ignore_region")
    ok = relevant & F.coalesce(F.col("review_status").isin("confirmed", "auto_confirmed"), F.lit(False))
    return (
        boxes.groupBy("page_id")
        .agg(F.count_if(relevant).alias("relevant"), F.count_if(ok).alias("confirmed"))
        .where((F.col("relevant") == 0) | (F.col("confirmed") / F.col("relevant") >= ratio))
    )


def quality_stats(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages with boxes, with metrics, without; quality jobs by status."""
    per_page = (
        results.where(F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.max("has_boxes").alias("_b"), F.max("has_metrics").alias("_m"))
        .agg(F.count_if("_b").alias("pages_with_boxes"), F.count_if("_m").alias("pages_with_metrics"))
    )
    states = ("pending", "running", "completed", "failed")
    per_state = jobs.where(F.col("job_type") == "quality").agg(
        *[F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in states],
        F.count(F.lit(1)).alias("jobs_total"),
    )
    both = per_page.unionByName(per_state, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns]).withColumn(
        "pages_without_metrics", F.col("pages_with_boxes") - F.col("pages_with_metrics")
    )


def filter_by_coverage(
    rows: DataFrame,
    min_coverage: float | None = None,
    max_coverage: float | None = None,
    min_uncovered: float | None = None,
    max_uncovered: float | None = None,
) -> DataFrame:
    """P5: bounds on coverage and uncovered share; missing values take their defaults."""
    covered = F.coalesce(F.col("coverage"), F.lit(0.0))
    loose = F.coalesce(
        F.col("uncovered"), F.when(covered <= 1, 1 - covered).otherwise(F.lit(0.0))
    )
    rows = rows.withColumns({"coverage": covered, "uncovered": loose})
    for value, column, least in (
        (min_coverage, "coverage", True),
        (max_coverage, "coverage", False),
        (min_uncovered, "uncovered", True),
        (max_uncovered, "uncovered", False),
    ):
        if value is not None:
            rows = rows.where(F.col(column) >= value if least else F.col(column) <= value)
    return rows


def page_quality(
    results: DataFrame,
    boxes: DataFrame,
    dark: DataFrame,
    pages: DataFrame,
    width: int,
    height: int,
    **bounds,
) -> DataFrame:
    """The page quality table: newest measured result with density, ink, review, coverage."""
    measured = B.latest_results(results).select("page_id", F.col("id").alias("result_id"))
    box_ink = ink.box_black_pixels(boxes, dark, width, height)
    rows = (
        pages.select(F.col("id").alias("page_id"), "document_id", "page_number")
        .join(measured, "page_id")
        .join(density_and_review(boxes), "page_id", "left")
        .join(ink.page_black_px(box_ink), "page_id", "left")
        .join(ink.page_coverage(dark, boxes, width, height), "page_id", "left")
    )
    return filter_by_coverage(rows, **bounds)


def review_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """A10: pages with results: how many, any boxes, time of the last; newest page first."""
    per_page = results.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("result_count"),
        F.bool_or("has_boxes").alias("any_boxes"),
        F.max("created_s").alias("last_result_s"),
    )
    return (
        pages.select(F.col("id").alias("page_id"), "document_id", "page_number")
        .join(per_page, "page_id")
        .orderBy(F.desc("page_id"))
    )


# --- angles --------------------------------------------------------------------


def deskew_overview(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page boxes, valid boxes, those with an angle and their share; the page angle."""
    valid = G.has_corners()
    angled = valid & F.col("deskew_angle").isNotNull()
    per_page = boxes.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total_boxes"),
        F.count_if(valid).alias("valid_boxes"),
        F.count_if(angled).alias("with_angle"),
    )
    p = pages.select(F.col("id").alias("page_id"), round_even(F.col("deskew_angle"), 2).alias("page_angle"))
    return p.join(per_page, "page_id").withColumn(
        "angle_pct",
        F.when(F.col("valid_boxes") > 0, round_even(F.lit(100.0) * F.col("with_angle") / F.col("valid_boxes"), 1)),
    )


def segment_angle() -> Column:
    """Angle of a segment in degrees, folded into -45..45."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    a = F.degrees(F.atan2(dy.cast("double"), dx + F.lit(1e-6)))
    return F.when(a > 45, a - 90).when(a < -45, a + 90).otherwise(a)


def valid_lines(segments: DataFrame, most: float = 15.0) -> DataFrame:
    """Segments that count for the page angle, with angle and length."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return segments.withColumns(
        {"angle": segment_angle(), "length": F.sqrt((dx * dx + dy * dy).cast("double"))}
    ).where(F.abs("angle") <= most)


def skew_angle(segments: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Median, min, max, mean, population deviation and number of usable angles.

    Pages listed in ``pages`` without a usable segment have 0.0 throughout.
    """
    lines = valid_lines(segments)
    stats = lines.groupBy("page_id").agg(
        F.min("angle").alias("min_angle"),
        F.max("angle").alias("max_angle"),
        F.avg("angle").alias("mean_angle"),
        F.stddev_pop("angle").alias("std_angle"),
        F.count(F.lit(1)).alias("line_count"),
    )
    rows = stats.join(spread.exact_median(lines, ["page_id"], "angle", "skew_angle"), "page_id")
    if pages is not None:
        rows = pages.select("page_id").distinct().join(rows, "page_id", "left")
    names = ["skew_angle", "min_angle", "max_angle", "mean_angle", "std_angle"]
    return rows.select(
        "page_id",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names],
        F.coalesce(F.col("line_count"), F.lit(0)).alias("line_count"),
    )


def pages_without_angle(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """Pages with no angle yet, filled from their segments (4 decimals).

    A page without segments at all is a failure: its angle stays null.
    """
    todo = pages.where(F.col("deskew_angle").isNull()).select(
        F.col("id").alias("page_id"), "document_id", "page_number"
    )
    seen = segments.select("page_id").distinct()
    angles = skew_angle(segments, seen).select("page_id", "skew_angle")
    return todo.join(angles, "page_id", "left").select(
        "page_id",
        "document_id",
        "page_number",
        round_even(F.col("skew_angle"), 4).alias("deskew_angle"),
        F.col("skew_angle").isNull().alias("failed"),
    )


# --- metrics on boxes ------------------------------------------------------------


def merge_box_metrics(density: DataFrame, black: DataFrame, review: DataFrame) -> DataFrame:
    """Density list with ink and review state, matched by result and box index."""
    keys = ["result_id", "box_index"]
    return (
        density.join(black.select(*keys, "black_pixels", "black_pixels_per_char"), keys, "left")
        .join(review.select(*keys, "review_status"), keys, "left")
        .withColumn("review_status", F.coalesce(F.col("review_status"), F.lit("pending")))
    )


def backfill_metrics(boxes: DataFrame, ink_rows: DataFrame, image_width: Column | int | None) -> DataFrame:
    """Recompute the box metrics of all boxes, take ink by index, clear the stale flag."""
    fresh = B.with_box_metrics(boxes.drop("black_pixels", "black_pixels_per_char"), image_width)
    return fresh.join(
        ink_rows.select("page_id", "box_index", "black_pixels", "black_pixels_per_char"),
        ["page_id", "box_index"],
        "left",
    ).withColumn("metrics_stale", F.lit(False))


def recalc_boxes(boxes: DataFrame, selected: DataFrame, dark: DataFrame, width: int, height: int) -> DataFrame:
    """Ink of the selected boxes only; they are no longer stale."""
    keys = ["page_id", "box_index"]
    chosen = boxes.join(selected.select(*keys).distinct(), keys, "left_semi")
    return ink.box_black_pixels(chosen, dark, width, height).withColumn("metrics_stale", F.lit(False))


def mean_word_confidence(words: DataFrame) -> DataFrame:
    """Mean of the word confidences above 0, as 0..1; none gives null."""
    c = F.expr("try_cast(try_cast(conf AS DOUBLE) AS INT)")
    return words.groupBy("result_id").agg((F.avg(F.when(c > 0, c)) / 100).alias("confidence"))
