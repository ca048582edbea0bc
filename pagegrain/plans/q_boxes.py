"""Queries on boxes and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import geometry as G
from pagegrain.functions import text as T
from pagegrain.operators import boxes as B
from pagegrain.operators import ink
from pagegrain.plans import sqlbits as S
from pagegrain.plans.registry import query

_BOX = "page_id, box_index"


def boxes_with_results(b):
    """Each page's boxes belong to its vision result (id = 3 * page + 2)."""
    return b.a_box.withColumn("result_id", F.col("page_id") * 3 + 2)


def documents_of(b):
    """The documents the pages belong to, with a title for every second one."""
    ids = b.a_page.select(F.col("document_id").alias("id")).distinct()
    return ids.select(
        "id",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("Titel "), F.col("id").cast("string"))).alias("title"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("datei"), F.col("id").cast("string"), F.lit(".pdf"))).alias("filename"),
    )


DOCUMENTS = """
SELECT DISTINCT document_id AS id, CASE WHEN document_id % 2 = 0 THEN concat('Titel ', document_id) END AS title,
  CASE WHEN document_id % 3 = 0 THEN concat('datei', document_id, '.pdf') END AS filename FROM a_page
"""

CONTEXT = f"""
SELECT b.*, p.document_id, p.page_number, d.title, d.filename
FROM ({S.BOX_METRICS}) b JOIN a_result r ON r.id = b.page_id * 3 + 2
JOIN a_page p ON p.id = r.page_id JOIN ({DOCUMENTS}) d ON d.id = p.document_id
"""


def context(b):
    boxes = B.with_box_metrics(boxes_with_results(b), S.WIDTH).drop("page_id")
    return B.box_context(boxes, b.a_result, b.a_page, documents_of(b))


@query(
    "p1_filter_boxes",
    f"""SELECT {_BOX}, document_id, page_number, char_count, chars_per_1k_px FROM ({CONTEXT})
    WHERE page_number BETWEEN 2 AND 40 AND coalesce(review_status, 'pending') IN ('pending', 'confirmed')
      AND box_type = 'ocr' AND text ILIKE '%the%' AND char_count >= 10 AND chars_per_1k_px >= 1 AND width_pct <= 60""",
)
def _(b):
    hit = B.filter_boxes(
        context(b),
        page_number_min=2,
        page_number_max=40,
        review_status=["pending", "confirmed"],
        box_type=["normal", "persistent_region"],
        text_search=" the ",
        min_char_count=10,
        min_chars_per_1k_px=1,
        max_width_pct=60,
    )
    return hit.select("page_id", "box_index", "document_id", "page_number", "char_count", "chars_per_1k_px")


@query(
    "p2_filter_boxes_json",
    f"""SELECT {_BOX}, char_count, review_status FROM ({S.BOX_METRICS})
    WHERE coalesce(review_status, 'pending') IN ('pending', 'new') AND NOT persistent AND lower({S.strip('text')}) LIKE '%en%'
      AND char_count BETWEEN 5 AND 400 AND left_pct <= 30 AND right_pct >= 20""",
)
def _(b):
    hit = B.filter_boxes_lenient(
        B.with_box_metrics(b.a_box, S.WIDTH),
        review_status=["pending", "new"],
        box_type=["normal", "note"],
        text_search="en",
        min_char_count=5,
        max_char_count=400,
        max_left_pct=30,
        min_right_pct=20,
    )
    return hit.select("page_id", "box_index", "char_count", "review_status")


@query(
    "p3_box_kind",
    f"SELECT {_BOX}, CASE WHEN persistent THEN 'persistent_region' WHEN box_type = 'note' THEN 'note' ELSE 'normal' END AS kind FROM a_box",
)
def _(b):
    return b.a_box.select("page_id", "box_index", B.box_kind().alias("kind"))


@query(
    "p4_box_list_projection",
    f"""SELECT concat(page_id, '_', box_index) AS id, document_id,
      coalesce(title, filename, concat('Dokument #', document_id)) AS document_title, page_id, page_number, box_index,
      substr(text, 1, 50) AS text_preview, coalesce(review_status, 'pending') AS review_status FROM ({CONTEXT})""",
)
def _(b):
    return B.box_list(context(b))


@query(
    "p6_boxes_to_recognise",
    f"SELECT {_BOX}, text FROM a_box WHERE review_status = 'new' AND (box_type IS NULL OR box_type = 'ocr')",
)
def _(b):
    return B.boxes_to_recognise(b.a_box).select("page_id", "box_index", "text")


@query("p7_boxes_of_type", f"SELECT {_BOX}, text FROM a_box WHERE box_type = 'ignore_region'")
def _(b):
    return B.boxes_of_type(b.a_box, "ignore_region").select("page_id", "box_index", "text")


@query(
    "p12_list_boxes_of_page",
    f"""SELECT {_BOX}, text, box_type, coalesce(review_status, 'pending') AS review_status
    FROM a_box JOIN ({S.BEST}) r USING (page_id) WHERE r.id = page_id * 3 + 2""",
)
def _(b):
    return B.list_boxes(boxes_with_results(b), b.a_result).select(
        "page_id", "box_index", "text", "box_type", "review_status"
    )


@query(
    "p15_inspect_boxes",
    f"""SELECT {_BOX}, coalesce(review_status, 'pending') AS review_status,
      row_number() OVER (PARTITION BY page_id ORDER BY {S.READING_ORDER}) - 1 AS pos FROM a_box""",
)
def _(b):
    return B.inspect_boxes(b.a_box, sort="reading").select("page_id", "box_index", "review_status", "pos")


@query(
    "p17_native_page_text",
    f"""SELECT page_id, n.id AS result_id, nullif({S.strip('b.text')}, '') AS native_text
    FROM (SELECT * FROM a_result WHERE source = 'pdf_native') n LEFT JOIN (SELECT * FROM a_box WHERE box_index = 0) b USING (page_id)""",
)
def _(b):
    return B.native_page_text(b.a_result, b.a_box)


@query("j1_box_context", f"SELECT {_BOX}, document_id, page_number, title, filename FROM ({CONTEXT})")
def _(b):
    return context(b).select("page_id", "box_index", "document_id", "page_number", "title", "filename")


@query("j2_latest_join", f"SELECT id, page_id, source, created_s FROM ({S.LATEST_TIES})")
def _(b):
    return B.latest_results(b.a_result).select("id", "page_id", "source", "created_s")


@query("w7_best_result", f"SELECT id, page_id, source, created_s FROM ({S.BEST})")
def _(b):
    return B.best_result(b.a_result).select("id", "page_id", "source", "created_s")


@query("w8_newest_result", f"SELECT id, page_id, source, created_s FROM ({S.NEWEST})")
def _(b):
    return B.newest_result(b.a_result).select("id", "page_id", "source", "created_s")


@query("u1_pages_with_boxes", "SELECT DISTINCT page_id FROM a_result WHERE has_boxes")
def _(b):
    return B.pages_with_boxes(b.a_result)


@query(
    "w1_box_index",
    "SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS box_index FROM a_result",
)
def _(b):
    return B.with_box_index(b.a_result, key="document_id", order="id").select("document_id", "id", "box_index")


@query(
    "w2_reading_order",
    f"SELECT {_BOX}, row_number() OVER (PARTITION BY page_id ORDER BY {S.READING_ORDER}) AS reading_pos FROM a_box",
)
def _(b):
    return B.with_reading_order(b.a_box).select("page_id", "box_index", "reading_pos")


_SIDES = ", ".join(
    f"coalesce(string_agg(nullif(t, ''), chr(10)) OVER (PARTITION BY page_id ORDER BY {S.READING_ORDER} ROWS BETWEEN {a} AND {z}), '') AS {n}"
    for n, a, z in (
        ("b2", "2 PRECEDING", "1 PRECEDING"),
        ("a2", "1 FOLLOWING", "2 FOLLOWING"),
        ("b4", "4 PRECEDING", "1 PRECEDING"),
        ("a4", "1 FOLLOWING", "4 FOLLOWING"),
    )
)


@query(
    "w3_neighbour_context",
    f"""SELECT {_BOX}, CASE WHEN length(b2) + length(a2) < 100 THEN b4 ELSE b2 END AS context_before,
      CASE WHEN length(b2) + length(a2) < 100 THEN a4 ELSE a2 END AS context_after
    FROM (SELECT {_BOX}, {_SIDES} FROM (SELECT *, {S.strip('text')} AS t FROM a_box))""",
)
def _(b):
    return B.neighbour_context(b.a_box).drop("reading_pos")


@query(
    "w3_full_page_context",
    f"""SELECT {_BOX}, greatest(coalesce(s, 0) - 1, 0) AS before_chars, coalesce(s, 0) + step AS after_from FROM (
      SELECT *, CAST(sum(step) OVER (PARTITION BY page_id ORDER BY {S.READING_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS s
      FROM (SELECT *, CASE WHEN length({S.strip('text')}) > 0 THEN length({S.strip('text')}) + 1 ELSE 0 END AS step FROM a_box))""",
)
def _(b):
    return B.full_page_context(b.a_box).drop("reading_pos")


@query(
    "w3_page_context_text",
    f"""SELECT page_id, string_agg(t, chr(10) ORDER BY {S.READING_ORDER}) AS text FROM (SELECT *, {S.strip('text')} AS t FROM a_box) WHERE t <> '' GROUP BY page_id""",
)
def _(b):
    return B.page_context_text(b.a_box)


@query("x1_page_text", S.PAGE_TEXT)
def _(b):
    return B.page_text(b.a_box)


# Units over box pages: unit u holds pages 4u .. 4u+3, in order.
UNIT_PAGES = "SELECT id // 4 AS unit_id, id % 4 AS pos, id AS page_id FROM a_page"


def unit_pages(b):
    return b.a_page.select(
        F.floor(F.col("id") / 4).cast("long").alias("unit_id"), (F.col("id") % 4).alias("pos"), F.col("id").alias("page_id")
    )


UNIT_TEXT = f"""
SELECT unit_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) AS text
FROM ({UNIT_PAGES}) LEFT JOIN ({S.PAGE_TEXT}) USING (page_id) GROUP BY unit_id
"""


@query("x1_unit_text", UNIT_TEXT)
def _(b):
    return B.unit_text(unit_pages(b), B.page_text(b.a_box))


@query(
    "t1_page_boxes",
    f"""SELECT document_id, page_number, page_id, box_index FROM ({CONTEXT}) WHERE char_count >= 20 AND box_type = 'ocr'
    ORDER BY document_id, page_number, page_id, box_index LIMIT 200 OFFSET 100""",
)
def _(b):
    rows = B.page_boxes(context(b), offset=100, limit=200, min_char_count=20, box_type=["normal"])
    return rows.select("document_id", "page_number", "page_id", "box_index")


@query(
    "j3_region_children",
    f"SELECT {_BOX}, region_index, char_length(text) AS chars FROM ({S.CHILDREN})",
)
def _(b):
    return ink.region_children(b.a_box).select(
        "page_id", "box_index", "region_index", F.length("text").cast("long").alias("chars")
    )


@query(
    "u4_pages_with_regions",
    f"SELECT DISTINCT page_id FROM a_box JOIN ({S.BEST}) r USING (page_id) WHERE persistent AND r.id = page_id * 3 + 2",
)
def _(b):
    return ink.pages_with_regions(B.list_boxes(boxes_with_results(b), b.a_result))


@query(
    "s5_replace_boxes",
    f"""SELECT {_BOX}, text, box_type, review_status, char_count, area_px, left_pct, chars_per_1k_px FROM (
      SELECT page_id, box_index, text, box_type, review_status, NULL::BIGINT AS char_count, NULL::BIGINT AS area_px, NULL::DOUBLE AS left_pct, NULL::DOUBLE AS chars_per_1k_px
      FROM a_box WHERE page_id NOT IN (SELECT item_id FROM benchmark)
      UNION ALL
      SELECT item_id, 0, text, 'ocr', 'pending', length(text), 800 * 100, 10.0, {S.round_even('1000 * length(text) / 80000', 2)} FROM benchmark)""",
)
def _(b):
    fresh = b.table("benchmark").select(
        F.col("item_id").alias("page_id"),
        F.lit(0).cast("long").alias("box_index"),
        "text",
        F.lit("").alias("box_type"),
        F.lit(None).cast("string").alias("review_status"),
        F.lit(100).alias("x1"),
        F.lit(50).alias("y1"),
        F.lit(900).alias("x2"),
        F.lit(150).alias("y2"),
    )
    stored = b.a_box.select(*fresh.columns)
    return B.replace_boxes(stored, fresh, S.WIDTH).select(
        "page_id", "box_index", "text", "box_type", "review_status", "char_count", "area_px", "left_pct", "chars_per_1k_px"
    )


@query(
    "f18_box_metrics",
    f"SELECT {_BOX}, char_count, area_px, left_pct, right_pct, width_pct, chars_per_1k_px FROM ({S.BOX_METRICS})",
)
def _(b):
    return B.with_box_metrics(b.a_box, S.WIDTH).select(
        "page_id", "box_index", "char_count", "area_px", "left_pct", "right_pct", "width_pct", "chars_per_1k_px"
    )


@query(
    "f19_box_density",
    f"SELECT {_BOX}, 1000 * n / greatest(abs((x2 - x1) * (y2 - y1)), 1) AS density FROM a_box",
)
def _(b):
    return b.a_box.select("page_id", "box_index", B.density_per_1k_px(b.a_box).alias("density"))


@query(
    "f25_relative_box",
    f"SELECT {_BOX}, x1 / 1000 AS rel_x1, y1 / 1600 AS rel_y1, x2 / 1000 AS rel_x2, y2 / 1600 AS rel_y2 FROM a_box",
)
def _(b):
    return b.a_box.select("page_id", "box_index", *G.relative_box(F.lit(S.WIDTH), F.lit(S.HEIGHT)))


@query(
    "f39_clip_box",
    f"""SELECT {_BOX}, x1, y1, greatest(x1 + 1, least(greatest(ox1 + 1, ox2), 1000)) AS x2, greatest(y1 + 1, least(greatest(oy1 + 1, oy2), 1600)) AS y2
    FROM (SELECT {_BOX}, x1 AS ox1, y1 AS oy1, x2 AS ox2, y2 AS oy2, greatest(0, least(x1, 999)) AS x1, greatest(0, least(y1, 1599)) AS y1 FROM a_box)""",
)
def _(b):
    return b.a_box.select(
        "page_id", "box_index", *[c.alias(k) for k, c in G.clip_box(S.WIDTH, S.HEIGHT).items()]
    )


# A recogniser that saw each region's lines in a crop, on a 0-1000 scale.
DETECTED = """
SELECT page_id AS region_id, box_index AS det_index, text, x1 / 1000 AS n1, y1 / 1600 AS n2, x2 / 1000 AS n3, y2 / 1600 AS n4
FROM a_box
"""


def detections(b):
    """Every line of a page as a detection in a 420 x 500 crop of region (100, 200, 700, 700)."""
    return b.a_box.select(
        F.col("page_id").alias("region_id"),
        F.col("box_index").alias("det_index"),
        "text",
        (F.col("x1") / 1000).alias("n1"),
        (F.col("y1") / 1600).alias("n2"),
        (F.col("x2") / 1000).alias("n3"),
        (F.col("y2") / 1600).alias("n4"),
        *[
            F.lit(v).cast("long").alias(k)
            for k, v in {
                "crop_w": 420, "crop_h": 500, "rx1": 100, "ry1": 200, "rx2": 700, "ry2": 700,
                "page_w": S.WIDTH, "page_h": S.HEIGHT,
            }.items()
        ],
    )


_CROPPED = f"""
WITH d AS (SELECT *, n1 * 420 AS p1, n2 * 500 AS p2, n3 * 420 AS p3, n4 * 500 AS p4, {S.strip('text')} AS t FROM ({DETECTED})),
s AS (SELECT *, p3 > 420 OR p4 > 500 AS k FROM d),
q AS (SELECT *, trunc(greatest(0, least(CASE WHEN k THEN p1 / 1000 * 420 ELSE p1 END, 420))) AS q1,
  trunc(greatest(0, least(CASE WHEN k THEN p2 / 1000 * 500 ELSE p2 END, 500))) AS q2 FROM s),
z AS (SELECT *, greatest(CASE WHEN k THEN 0 ELSE q1 + 1 END, trunc(least(CASE WHEN k THEN p3 / 1000 * 420 ELSE p3 END, 420))) AS q3,
  greatest(CASE WHEN k THEN 0 ELSE q2 + 1 END, trunc(least(CASE WHEN k THEN p4 / 1000 * 500 ELSE p4 END, 500))) AS q4 FROM q),
f AS (SELECT region_id, det_index, t AS text, CAST(greatest(100, trunc(100 + q1 / CAST(0.7 AS DOUBLE))) AS BIGINT) AS x1, CAST(greatest(200, 200 + q2) AS BIGINT) AS y1,
  CAST(least(700, trunc(100 + q3 / CAST(0.7 AS DOUBLE))) AS BIGINT) AS x2, CAST(least(700, 200 + q4) AS BIGINT) AS y2 FROM z),
g AS (SELECT * FROM f WHERE x2 > x1 AND y2 > y1 AND text <> '')
SELECT * FROM g UNION ALL
SELECT DISTINCT region_id, 0, '{G.EMPTY_REGION_TEXT}', 100, 200, 700, 700 FROM f WHERE region_id NOT IN (SELECT region_id FROM g)
"""


@query("f26_crop_to_page", _CROPPED)
def _(b):
    return B.crop_to_page(detections(b))


@query(
    "f27_recrop_to_page",
    f"""WITH d AS (SELECT *, {S.strip('text')} AS t FROM ({DETECTED}) WHERE n3 > n1 AND n4 > n2),
    q AS (SELECT *, greatest(0, least(trunc(n1 * 420), 420)) AS q1, greatest(0, least(trunc(n2 * 500), 500)) AS q2 FROM d WHERE t <> ''),
    z AS (SELECT *, greatest(q1 + 1, least(trunc(n3 * 420), 420)) AS q3, greatest(q2 + 1, least(trunc(n4 * 500), 500)) AS q4 FROM q),
    f AS (SELECT region_id, det_index, t AS text, CAST(trunc(100 + q1 * (1 / CAST(0.7 AS DOUBLE)) / CAST(1.5 AS DOUBLE)) AS BIGINT) AS x1, CAST(trunc(200 + q2 / CAST(1.5 AS DOUBLE)) AS BIGINT) AS y1,
      CAST(trunc(100 + q3 * (1 / CAST(0.7 AS DOUBLE)) / CAST(1.5 AS DOUBLE)) AS BIGINT) AS xx, CAST(trunc(200 + q4 / CAST(1.5 AS DOUBLE)) AS BIGINT) AS yy FROM z)
    SELECT region_id, det_index, text, x1, y1, greatest(x1 + 1, xx) AS x2, greatest(y1 + 1, yy) AS y2 FROM f""",
)
def _(b):
    return B.recrop_to_page(detections(b), scale=1.5)


@query("f1_strip_whitespace", f"SELECT {_BOX}, {S.squeeze('text')} AS solid FROM a_box")
def _(b):
    return b.a_box.select("page_id", "box_index", T.strip_whitespace("text").alias("solid"))


@query(
    "f2_text_preview",
    f"SELECT {_BOX}, substr(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS preview FROM a_box",
)
def _(b):
    return b.a_box.select("page_id", "box_index", T.text_preview("text").alias("preview"))
