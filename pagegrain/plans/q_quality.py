"""Queries on page quality, ink, angles and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.operators import boxes as B
from pagegrain.operators import ink
from pagegrain.operators import quality as Q
from pagegrain.plans import sqlbits as S
from pagegrain.plans.registry import query

W, H = S.WIDTH, S.HEIGHT


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("a1_page_density", S.DENSITY)
def _(b):
    return Q.page_density(b.a_box)


@query("a2_page_black_px", S.PAGE_INK)
def _(b):
    return ink.page_black_px(ink.box_black_pixels(b.a_box, b.a_dark, W, H))


@query("a3_reviewed_pct", S.REVIEWED)
def _(b):
    return Q.reviewed_pct(b.a_box)


@query("j4_uncovered_pixels", S.UNCOVERED)
def _(b):
    return ink.uncovered_pixels(b.a_dark, b.a_box, W, H)


@query(
    "a4_page_coverage",
    f"""SELECT page_id, coalesce(total_dark, 0) AS total_dark, coalesce(uncovered_dark, 0) AS uncovered_dark,
      coalesce(coverage, 1.0) AS coverage, coalesce(uncovered, 0.0) AS uncovered
    FROM (SELECT id AS page_id FROM a_page) LEFT JOIN ({S.COVERAGE}) USING (page_id)""",
)
def _(b):
    return ink.page_coverage(b.a_dark, b.a_box, W, H, b.a_page.select(F.col("id").alias("page_id")))


_IN_REGION = f"""
SELECT r.page_id, r.region_index, d.x, d.y FROM (SELECT page_id, box_index AS region_index, greatest(0, least(x1, {W})) AS l, greatest(0, least(y1, {H})) AS t,
  greatest(0, least(x2, {W})) AS r, greatest(0, least(y2, {H})) AS b FROM a_box WHERE persistent) r
JOIN a_dark d ON d.page_id = r.page_id AND d.x >= r.l AND d.x < r.r AND d.y >= r.t AND d.y < r.b
"""

_REGION_COVERAGE = f"""
WITH inside AS ({_IN_REGION}), kids AS ({S.CHILDREN}),
t AS (SELECT page_id, region_index, count(*) AS t FROM inside GROUP BY ALL),
u AS (SELECT page_id, region_index, count(*) AS u FROM inside i WHERE NOT EXISTS (SELECT 1 FROM kids k WHERE k.page_id = i.page_id
  AND k.region_index = i.region_index AND i.x >= k.x1 AND i.x < k.x2 AND i.y >= k.y1 AND i.y < k.y2) GROUP BY ALL)
SELECT page_id, box_index AS region_index, coalesce(t, 0) AS total_dark, coalesce(u, 0) AS uncovered_dark,
  coalesce(1 - coalesce(u, 0) / t, 1.0) AS coverage, coalesce(coalesce(u, 0) / t, 0.0) AS uncovered
FROM (SELECT page_id, box_index, box_index AS region_index FROM a_box WHERE persistent) LEFT JOIN t USING (page_id, region_index) LEFT JOIN u USING (page_id, region_index)
"""

_CHILD_INK = f"""
SELECT k.page_id, k.region_index, k.box_index, count(d.x) AS black_pixels, k.n AS char_count,
  CASE WHEN k.n > 0 THEN count(d.x) / k.n END AS black_pixels_per_char
FROM ({S.CHILDREN}) k LEFT JOIN a_dark d ON d.page_id = k.page_id AND d.x >= k.x1 AND d.x < k.x2 AND d.y >= k.y1 AND d.y < k.y2
GROUP BY k.page_id, k.region_index, k.box_index, k.n
"""

_ROLLUP = f"""
SELECT r.page_id, r.box_index AS region_index, count(k.box_index) AS child_count, CAST(sum(k.black_pixels) AS BIGINT) AS black_pixels, CAST(sum(k.char_count) AS BIGINT) AS char_count,
  sum(k.black_pixels) / nullif(sum(k.char_count), 0) AS black_pixels_per_char
FROM (SELECT * FROM a_box WHERE persistent) r LEFT JOIN ({_CHILD_INK}) k ON k.page_id = r.page_id AND k.region_index = r.box_index
GROUP BY r.page_id, r.box_index
"""


@query("a5_region_coverage", _REGION_COVERAGE)
def _(b):
    return ink.region_coverage(b.a_box, b.a_dark, W, H)


@query("a5_region_child_ink", _CHILD_INK)
def _(b):
    return ink.region_child_ink(b.a_box, b.a_dark, W, H)


@query("a6_region_rollup", _ROLLUP)
def _(b):
    return ink.region_rollup(b.a_box, ink.region_child_ink(b.a_box, b.a_dark, W, H))


@query("a7_box_black_pixels", S.BOX_INK)
def _(b):
    return ink.box_black_pixels(b.a_box, b.a_dark, W, H)


@query(
    "t3_sort_regions",
    f"""SELECT page_id, region_index, child_count, round(coverage, 6) AS coverage FROM ({_ROLLUP}) JOIN ({_REGION_COVERAGE.strip()}) USING (page_id, region_index)
    WHERE uncovered <= 0.99 ORDER BY coalesce(coverage, -1) DESC, page_id, region_index LIMIT 40 OFFSET 2""",
)
def _(b):
    rows = ink.sort_regions(
        ink.region_list(b.a_box, b.a_dark, W, H), "coverage", descending=True, offset=2, limit=40, max_uncovered=0.99
    )
    return rounded(rows.select("page_id", "region_index", "child_count", "coverage"), "coverage")


@query(
    "a8_quality_stats",
    """WITH p AS (SELECT page_id, bool_or(has_boxes) AS b, bool_or(has_metrics) AS m FROM a_result GROUP BY page_id),
    j AS (SELECT count(*) FILTER (status = 'pending') AS jobs_pending, count(*) FILTER (status = 'running') AS jobs_running,
      count(*) FILTER (status = 'completed') AS jobs_completed, count(*) FILTER (status = 'failed') AS jobs_failed, count(*) AS jobs_total FROM a_job WHERE job_type = 'quality')
    SELECT count(*) FILTER (b) AS pages_with_boxes, count(*) FILTER (m) AS pages_with_metrics, count(*) FILTER (b) - count(*) FILTER (m) AS pages_without_metrics,
      any_value(jobs_pending) AS jobs_pending, any_value(jobs_running) AS jobs_running, any_value(jobs_completed) AS jobs_completed, any_value(jobs_failed) AS jobs_failed, any_value(jobs_total) AS jobs_total FROM p, j""",
)
def _(b):
    return Q.quality_stats(b.a_result, b.a_job)


@query(
    "a10_review_pages",
    """SELECT p.id AS page_id, p.document_id, p.page_number, count(*) AS result_count, bool_or(r.has_boxes) AS any_boxes, max(r.created_s) AS last_result_s
    FROM a_page p JOIN a_result r ON r.page_id = p.id GROUP BY ALL""",
)
def _(b):
    return Q.review_pages(b.a_result, b.a_page)


@query(
    "a11_deskew_overview",
    f"""SELECT p.id AS page_id, {S.round_even('p.deskew_angle', 2)} AS page_angle, count(*) AS total_boxes, count(*) AS valid_boxes,
      count(*) FILTER ((page_id + box_index) % 3 <> 0) AS with_angle, {S.round_even('CAST(100.0 AS DOUBLE) * count(*) FILTER ((page_id + box_index) % 3 <> 0) / count(*)', 1)} AS angle_pct
    FROM a_box b JOIN a_page p ON p.id = b.page_id GROUP BY p.id, p.deskew_angle""",
)
def _(b):
    boxes = b.a_box.withColumn(
        "deskew_angle", F.when((F.col("page_id") + F.col("box_index")) % 3 != 0, F.lit(0.5))
    )
    return Q.deskew_overview(boxes, b.a_page)


_ANGLES = ("skew_angle", "min_angle", "max_angle", "mean_angle", "std_angle")


@query(
    "a12_skew_angle",
    f"SELECT page_id, line_count, {', '.join(f'round({c}, 6) AS {c}' for c in _ANGLES)} FROM ({S.SKEW})",
)
def _(b):
    return rounded(Q.skew_angle(b.a_segment), *_ANGLES)


@query(
    "p18_valid_lines",
    f"""SELECT page_id, id, round(angle, 6) AS angle, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length
    FROM ({S.SEGMENT_ANGLES}) WHERE abs(angle) <= 15""",
)
def _(b):
    return rounded(Q.valid_lines(b.a_segment).select("page_id", "id", "angle", "length"), "angle", "length")


@query(
    "p16_pages_without_angle",
    f"""SELECT p.id AS page_id, p.document_id, p.page_number, {S.round_even('s.skew_angle', 4)} AS deskew_angle, s.skew_angle IS NULL AS failed
    FROM a_page p LEFT JOIN ({S.SKEW}) s ON s.page_id = p.id WHERE p.deskew_angle IS NULL""",
)
def _(b):
    return Q.pages_without_angle(b.a_page, b.a_segment)


_QUALITY = f"""
SELECT p.id AS page_id, p.document_id, p.page_number, l.id AS result_id, d.median_density, d.min_density, d.max_density, d.box_count,
  r.countable_boxes, r.reviewed_pct, k.min_black_px, k.max_black_px, k.boxes_with_chars, c.total_dark, c.uncovered_dark,
  coalesce(c.coverage, 0.0) AS coverage, coalesce(c.uncovered, 1.0) AS uncovered
FROM a_page p JOIN ({S.LATEST_TIES}) l ON l.page_id = p.id LEFT JOIN ({S.DENSITY}) d ON d.page_id = p.id LEFT JOIN ({S.REVIEWED}) r ON r.page_id = p.id
LEFT JOIN ({S.PAGE_INK}) k ON k.page_id = p.id LEFT JOIN ({S.COVERAGE}) c ON c.page_id = p.id
"""


@query("x14_page_quality", _QUALITY)
def _(b):
    return Q.page_quality(b.a_result, b.a_box, b.a_dark, b.a_page, W, H)


@query(
    "p5_filter_pages_by_coverage",
    f"SELECT page_id, result_id, round(coverage, 6) AS coverage, round(uncovered, 6) AS uncovered FROM ({_QUALITY}) WHERE coverage >= 0.05 AND uncovered <= 0.94",
)
def _(b):
    rows = Q.page_quality(b.a_result, b.a_box, b.a_dark, b.a_page, W, H, min_coverage=0.05, max_uncovered=0.94)
    return rounded(rows.select("page_id", "result_id", "coverage", "uncovered"), "coverage", "uncovered")


@query(
    "a17_confirmed_pages",
    f"""SELECT page_id, count(*) FILTER (box_type = 'ocr') AS relevant, count(*) FILTER (box_type = 'ocr' AND review_status IN ('confirmed', 'auto_confirmed')) AS confirmed
    FROM a_box JOIN ({S.NEWEST}) r USING (page_id) GROUP BY page_id
    HAVING count(*) FILTER (box_type = 'ocr') = 0 OR count(*) FILTER (box_type = 'ocr' AND review_status IN ('confirmed', 'auto_confirmed')) / count(*) FILTER (box_type = 'ocr') >= 0.4""",
)
def _(b):
    newest = B.newest_result(b.a_result).select("page_id")
    return Q.confirmed_pages(b.a_box.join(newest, "page_id", "left_semi"), 0.4)


@query(
    "j15_merge_box_metrics",
    f"""SELECT d.page_id * 3 AS result_id, d.box_index, d.density, k.black_pixels, k.black_pixels_per_char, coalesce(d.review_status, 'pending') AS review_status
    FROM (SELECT *, 1000 * n / greatest(abs((x2 - x1) * (y2 - y1)), 1) AS density FROM a_box) d LEFT JOIN ({S.BOX_INK}) k USING (page_id, box_index)""",
)
def _(b):
    result = (F.col("page_id") * 3).alias("result_id")
    boxes = b.a_box
    return Q.merge_box_metrics(
        boxes.select(result, "box_index", B.density_per_1k_px(boxes).alias("density")),
        ink.box_black_pixels(boxes, b.a_dark, W, H).select(
            result, "box_index", "black_pixels", "black_pixels_per_char"
        ),
        boxes.select(result, "box_index", "review_status"),
    )


@query(
    "m11_backfill_metrics",
    f"""SELECT page_id, box_index, m.char_count, area_px, chars_per_1k_px, k.black_pixels, k.black_pixels_per_char, false AS metrics_stale
    FROM ({S.BOX_METRICS}) m LEFT JOIN ({S.BOX_INK}) k USING (page_id, box_index)""",
)
def _(b):
    rows = Q.backfill_metrics(b.a_box, ink.box_black_pixels(b.a_box, b.a_dark, W, H), W)
    return rows.select(
        "page_id", "box_index", "char_count", "area_px", "chars_per_1k_px", "black_pixels", "black_pixels_per_char", "metrics_stale"
    )


@query(
    "m12_recalc_boxes",
    f"SELECT k.*, false AS metrics_stale FROM ({S.BOX_INK}) k JOIN a_box USING (page_id, box_index) WHERE review_status = 'new'",
)
def _(b):
    return Q.recalc_boxes(b.a_box, b.a_box.where(F.col("review_status") == "new"), b.a_dark, W, H)


@query(
    "w5_best_stage",
    """WITH s AS (SELECT o_custkey AS region_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stage,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(o_totalprice / 500000, 1) END AS coverage FROM orders),
      f AS (SELECT *, min(CASE WHEN coverage >= 0.85 THEN stage END) OVER (PARTITION BY region_id) AS stop FROM s),
      k AS (SELECT * FROM f WHERE stage <= 4 AND (stop IS NULL OR stage <= stop))
    SELECT region_id, count(*) AS stages_used, arg_min(stage, (-coverage, stage)) FILTER (coverage IS NOT NULL) AS best_stage, max(coverage) AS best_coverage FROM k GROUP BY region_id""",
)
def _(b):
    orders = b.table("orders").withColumn("id", F.col("o_orderkey"))
    stages = B.with_box_index(orders, key="o_custkey", order="id").select(
        F.col("o_custkey").alias("region_id"),
        (F.col("box_index") + 1).alias("stage"),
        F.when(F.col("o_orderkey") % 9 != 0, F.round(F.col("o_totalprice") / 500000, 1)).alias("coverage"),
    )
    return ink.best_stage(stages)


