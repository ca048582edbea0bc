"""Pieces of DuckDB SQL shared by the oracle queries."""

# The whitespace set of functions.text.SPACES in RE2 syntax.
WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

WIDTH = 1000
HEIGHT = 1600


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(e: str) -> str:
    return f"regexp_replace({e}, '[{WS}]+', '', 'g')"


def round_even(e: str, digits: int) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"round_even(({e}) * {scale}, 0) / {scale}"


READING_ORDER = "(y1 // 15) * 15, x1, y1, box_index"

# text of every page of a_box in reading order
PAGE_TEXT = f"""
SELECT page_id, string_agg(t, chr(10) ORDER BY {READING_ORDER}) AS text
FROM (SELECT *, {strip('text')} AS t FROM a_box)
WHERE t <> '' AND box_type NOT IN ('ignore_region', 'note')
  AND NOT starts_with(t, '[Region - ') AND NOT starts_with(t, '[Ignore-Bereich]')
GROUP BY page_id
"""

# best result per page of a_result
BEST = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY
  CASE source WHEN 'ollama_vision' THEN 0 WHEN 'pdf_native' THEN 1 ELSE 2 END, created_s DESC, id DESC) AS rn
  FROM a_result WHERE has_boxes) WHERE rn = 1
"""

NEWEST = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY created_s DESC, id DESC) AS rn
  FROM a_result WHERE has_boxes) WHERE rn = 1
"""

LATEST_TIES = """
SELECT r.* FROM a_result r JOIN (SELECT page_id, max(created_s) AS m FROM a_result WHERE has_metrics GROUP BY page_id) l
  ON r.page_id = l.page_id AND r.created_s = l.m WHERE r.has_metrics
"""

BOX_METRICS = f"""
SELECT *, n AS char_count, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area_px,
  {round_even(f"x1 / {WIDTH} * 100", 2)} AS left_pct, {round_even(f"x2 / {WIDTH} * 100", 2)} AS right_pct,
  {round_even(f"greatest(0, x2 - x1) / {WIDTH} * 100", 2)} AS width_pct,
  CASE WHEN greatest(0, x2 - x1) * greatest(0, y2 - y1) > 0 AND n > 0
    THEN {round_even("1000 * n / (greatest(0, x2 - x1) * greatest(0, y2 - y1))", 2)} END AS chars_per_1k_px
FROM a_box
"""

DENSITY = """
SELECT page_id, coalesce(median(d), 0.0) AS median_density, coalesce(min(d), 0.0) AS min_density,
  coalesce(max(d), 0.0) AS max_density, count(d) AS box_count
FROM (SELECT page_id, 1000 * n / greatest(abs((x2 - x1) * (y2 - y1)), 1) AS d FROM a_box) GROUP BY page_id
"""

REVIEWED = f"""
SELECT page_id, countable_boxes, coalesce({round_even("CAST(100.0 AS DOUBLE) * ok / nullif(countable_boxes, 0)", 1)}, 0.0) AS reviewed_pct
FROM (SELECT page_id, count(*) FILTER (box_type <> 'note') AS countable_boxes,
  count(*) FILTER (box_type <> 'note' AND review_status IN ('confirmed', 'rejected', 'auto_confirmed')) AS ok FROM a_box GROUP BY page_id)
"""

CROPS = f"""
SELECT page_id, box_index, n AS char_count,
  greatest(0, least(trunc(x1 * CAST(0.7 AS DOUBLE)), trunc(x2 * CAST(0.7 AS DOUBLE))) - 5) AS l, greatest(0, least(y1, y2) - 5) AS t,
  least({WIDTH}, greatest(trunc(x1 * CAST(0.7 AS DOUBLE)), trunc(x2 * CAST(0.7 AS DOUBLE))) + 5) AS r, least({HEIGHT}, greatest(y1, y2) + 5) AS b
FROM a_box
"""

BOX_INK = f"""
SELECT c.page_id, c.box_index, count(d.x) AS black_pixels, c.char_count,
  CASE WHEN c.char_count > 0 THEN count(d.x) / c.char_count END AS black_pixels_per_char
FROM ({CROPS}) c LEFT JOIN a_dark d ON d.page_id = c.page_id AND d.x >= c.l AND d.x < c.r AND d.y >= c.t AND d.y < c.b
WHERE c.l <= c.r AND c.t <= c.b
GROUP BY c.page_id, c.box_index, c.char_count
"""

PAGE_INK = f"""
SELECT page_id, min(black_pixels_per_char) AS min_black_px, max(black_pixels_per_char) AS max_black_px,
  count(black_pixels_per_char) AS boxes_with_chars FROM ({BOX_INK}) GROUP BY page_id
"""

UNCOVERED = f"""
SELECT d.page_id, d.x, d.y FROM a_dark d WHERE NOT EXISTS (
  SELECT 1 FROM a_box b WHERE b.page_id = d.page_id
    AND d.x >= greatest(0, least(b.x1, {WIDTH})) AND d.x < greatest(0, least(b.x2, {WIDTH}))
    AND d.y >= greatest(0, least(b.y1, {HEIGHT})) AND d.y < greatest(0, least(b.y2, {HEIGHT})))
"""

COVERAGE = f"""
SELECT page_id, t AS total_dark, coalesce(u, 0) AS uncovered_dark,
  1 - coalesce(u, 0) / t AS coverage, coalesce(u, 0) / t AS uncovered
FROM (SELECT page_id, count(*) AS t FROM a_dark GROUP BY page_id)
LEFT JOIN (SELECT page_id, count(*) AS u FROM ({UNCOVERED}) GROUP BY page_id) USING (page_id)
"""

CHILDREN = """
SELECT c.*, r.box_index AS region_index, r.x1 AS rx1, r.y1 AS ry1, r.x2 AS rx2, r.y2 AS ry2
FROM a_box c JOIN a_box r ON c.page_id = r.page_id AND r.persistent
WHERE c.box_index <> r.box_index AND NOT c.persistent AND c.box_type NOT IN ('ignore_region', 'note')
  AND c.x1 >= r.x1 AND c.y1 >= r.y1 AND c.x2 <= r.x2 AND c.y2 <= r.y2
"""

SEGMENT_ANGLES = """
SELECT *, CASE WHEN a > 45 THEN a - 90 WHEN a < -45 THEN a + 90 ELSE a END AS angle FROM (
  SELECT *, degrees(atan2(CAST(y2 - y1 AS DOUBLE), (x2 - x1) + CAST(1e-6 AS DOUBLE))) AS a FROM a_segment)
"""

SKEW = f"""
SELECT page_id, median(angle) AS skew_angle, min(angle) AS min_angle, max(angle) AS max_angle,
  avg(angle) AS mean_angle, stddev_pop(angle) AS std_angle, count(*) AS line_count
FROM ({SEGMENT_ANGLES}) WHERE abs(angle) <= 15 GROUP BY page_id
"""
