"""Small hand-written frames: nulls, ties, empty inputs and brute-force checks."""

import random

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import claims as C
from pagegrain.functions import geometry as G
from pagegrain.functions import parsing as P
from pagegrain.functions import scores as S
from pagegrain.functions import text as T
from pagegrain.functions import web as W
from pagegrain.operators import agreement as A
from pagegrain.operators import boxes as B
from pagegrain.operators import graph as GR
from pagegrain.operators import ink
from pagegrain.operators import jobs as J
from pagegrain.operators import people as PE
from pagegrain.operators import quality as Q
from pagegrain.operators import review as R
from pagegrain.operators import units as U
from pagegrain.operators.authority import match_authority
from pagegrain.sources import archive, grounding, ntriples

BOX = (
    "page_id long, box_index long, x1 long, y1 long, x2 long, y2 long, text string, "
    "box_type string, review_status string, persistent boolean"
)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def box(page, index, corners=(0, 0, 10, 10), text="x", kind="ocr", status="new", persistent=False):
    return (page, index, *(corners or (None,) * 4), text, kind, status, persistent)


def one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


# --- boxes ------------------------------------------------------------------------------


def test_reading_order_puts_boxes_without_corners_last_and_is_stable(spark):
    df = spark.createDataFrame(
        [
            box(1, 0, None),
            box(1, 1, (50, 14, 60, 20)),
            box(1, 2, (10, 3, 20, 9)),
            box(1, 3, (0, 15, 5, 20)),
            box(1, 4, (10, 3, 30, 9)),
            box(1, 5, None),
        ],
        BOX,
    )
    got = dict(rows(B.with_reading_order(df), "box_index", "reading_pos"))
    assert got == {2: 1, 4: 2, 1: 3, 3: 4, 0: 5, 5: 6}
    # without a tolerance every top edge is its own line
    got = dict(rows(B.with_reading_order(df, 0), "box_index", "reading_pos"))
    assert got == {2: 1, 4: 2, 1: 3, 3: 4, 0: 5, 5: 6}


def test_page_text_skips_notes_placeholders_and_blanks(spark):
    df = spark.createDataFrame(
        [
            box(1, 0, (0, 40, 9, 50), "zwei "),
            box(1, 1, (0, 0, 9, 9), "\u00a0eins"),
            box(1, 2, (0, 60, 9, 70), "n", "note"),
            box(1, 3, (0, 80, 9, 90), "[Region - offen]"),
            box(1, 4, (0, 90, 9, 99), "  "),
            box(1, 5, (0, 95, 9, 99), "i", "ignore_region"),
            box(2, 0, (0, 0, 9, 9), ""),
        ],
        BOX,
    )
    assert rows(B.page_text(df)) == [(1, "eins\nzwei")]
    pages = spark.createDataFrame([(7, 0, 2), (7, 1, 1)], "unit_id long, pos long, page_id long")
    assert rows(B.unit_text(pages, B.page_text(df))) == [(7, "\n\neins\nzwei")]


def test_box_metrics_nulls(spark):
    df = spark.createDataFrame([box(1, 0, None, "ab"), box(1, 1, (10, 0, 60, 10), ""), box(1, 2, (10, 0, 60, 10), "abc")], BOX)
    cols = ("char_count", "area_px", "left_pct", "width_pct", "chars_per_1k_px")
    assert rows(B.with_box_metrics(df, 200), *cols) == [
        (2, 0, 0.0, 0.0, None),
        (0, 500, 5.0, 25.0, None),
        (3, 500, 5.0, 25.0, 6.0),
    ]
    assert rows(B.with_box_metrics(df, None), "left_pct") == [(None,)] * 3


def test_filters_treat_null_metrics_differently(spark):
    df = spark.createDataFrame([(1, 0, "abc", "ocr", None, None, False)], "page_id long, box_index long, text string, box_type string, review_status string, left_pct double, persistent boolean")
    assert B.filter_boxes(df, max_left_pct=50).count() == 0
    assert B.filter_boxes_lenient(df, max_left_pct=50).count() == 1
    assert B.filter_boxes(df, review_status=["pending"]).count() == 1
    assert B.filter_boxes(df, box_type=["persistent_region"]).count() == 1
    assert B.filter_boxes_lenient(df, box_type=["persistent_region"]).count() == 0
    assert B.filter_boxes_lenient(df, min_char_count=4).count() == 0


def test_latest_join_keeps_ties_and_newest_does_not(spark):
    df = spark.createDataFrame(
        [(1, 1, "tesseract", 5, True, True), (2, 1, "ollama_vision", 5, True, True), (3, None, "tesseract", 9, True, True), (4, 2, "pdf_native", 1, False, True)],
        "id long, page_id long, source string, created_s long, has_boxes boolean, has_metrics boolean",
    )
    assert sorted(rows(B.latest_results(df), "id")) == [(1,), (2,), (4,)]
    assert rows(B.newest_result(df), "id") == [(2,)]
    assert rows(B.best_result(df), "id") == [(2,)]


DETECTED = (
    "region_id long, det_index long, n1 double, n2 double, n3 double, n4 double, text string, crop_w long, crop_h long, "
    "rx1 long, ry1 long, rx2 long, ry2 long, page_w long, page_h long"
)


def test_crop_to_page(spark):
    region = (280, 200, 100, 200, 500, 400, 1000, 1500)
    df = spark.createDataFrame(
        [
            (1, 0, 0.1, 0.2, 0.8, 0.9, "Text", *region),
            (2, 0, 0.0, 0.0, 1.0, 1.0, "voll", *region),
            (3, 0, 0.5, 0.5, 0.5, 0.4, " ", *region),
            (4, 0, None, None, None, None, None, *region),
        ],
        DETECTED,
    )
    got = {r[0]: r[1:] for r in rows(B.crop_to_page(df), "region_id", "x1", "y1", "x2", "y2", "text")}
    assert got[1] == (140, 240, 420, 380, "Text")
    assert got[2] == (100, 200, 500, 400, "voll")
    assert got[3] == got[4] == (100, 200, 500, 400, G.EMPTY_REGION_TEXT)


def test_crop_to_page_thousand_scale(spark):
    df = one(spark, DETECTED, 1, 0, 0.5, 0.5, 2.0, 2.0, "t", 280, 200, 100, 200, 500, 400, 1000, 1500)
    # 140..560 and 100..400 read as thousandths of the crop
    assert rows(B.crop_to_page(df), "x1", "y1", "x2", "y2") == [(155, 220, 322, 280)]
    assert rows(B.crop_to_page(df, thousand_scale=False), "x1", "y1", "x2", "y2") == [(300, 300, 500, 400)]


def test_clip_box_stays_inside(spark):
    df = spark.createDataFrame([(-5, 3, 2000, 2), (1200, 0, 1300, 10)], "x1 long, y1 long, x2 long, y2 long")
    got = rows(df.select(*[c.alias(k) for k, c in G.clip_box(1000, 500).items()]))
    assert got == [(0, 3, 1000, 4), (999, 0, 1000, 10)]


# --- ink -------------------------------------------------------------------------------


def test_coverage_against_brute_force(spark):
    rnd = random.Random(3)
    w, h = 600, 100
    boxes = []
    for page in (1, 2, 3):
        for i in range(12):
            x, y = rnd.randint(-50, w), rnd.randint(-20, h)
            boxes.append(box(page, i, (x, y, x + rnd.randint(-5, 200), y + rnd.randint(0, 40)), "ab" * (i % 3)))
    pixels = {(p, rnd.randrange(w), rnd.randrange(h)) for p in (1, 2, 3) for _ in range(700)}
    bdf = spark.createDataFrame(boxes, BOX)
    ddf = spark.createDataFrame(list(pixels), "page_id long, x long, y long")

    def covered(p, x, y):
        return any(b[0] == p and b[2] <= x < b[4] and b[3] <= y < b[5] for b in boxes)

    want = {q for q in pixels if not covered(*q)}
    assert set(rows(ink.uncovered_pixels(ddf, bdf, w, h), "page_id", "x", "y")) == want
    cov = {r[0]: r[1:] for r in rows(ink.page_coverage(ddf, bdf, w, h), "page_id", "total_dark", "uncovered_dark")}
    assert cov == {p: (sum(q[0] == p for q in pixels), sum(q[0] == p for q in want)) for p in (1, 2, 3)}

    def crop(b):
        x = sorted((int(b[2] * 0.7), int(b[4] * 0.7)))
        y = sorted((b[3], b[5]))
        return max(0, x[0] - 5), max(0, y[0] - 5), min(w, x[1] + 5), min(h, y[1] + 5)

    black = {}
    for b in boxes:
        x1, y1, x2, y2 = crop(b)
        if x1 <= x2 and y1 <= y2:
            black[b[0], b[1]] = sum(q[0] == b[0] and x1 <= q[1] < x2 and y1 <= q[2] < y2 for q in pixels)
    got = {r[:2]: r[2] for r in rows(ink.box_black_pixels(bdf, ddf, w, h), "page_id", "box_index", "black_pixels")}
    assert got == black


def test_page_without_ink_and_empty_region(spark):
    bdf = spark.createDataFrame([box(1, 0, (2000, 0, 2100, 10), persistent=True), box(1, 1, (0, 0, 50, 50), persistent=True)], BOX)
    ddf = spark.createDataFrame([(9, 1, 1)], "page_id long, x long, y long")
    pages = spark.createDataFrame([(1,)], "page_id long")
    assert rows(ink.page_coverage(ddf, bdf, 1000, 100, pages)) == [(1, 0, 0, 1.0, 0.0)]
    got = sorted(rows(ink.region_coverage(bdf, ddf, 1000, 100), "region_index", "coverage", "uncovered"))
    assert got == [(0, 0.0, 1.0), (1, 1.0, 0.0)]
    assert sorted(rows(ink.region_rollup(bdf), "child_count", "black_pixels", "black_pixels_per_char")) == [(0, None, None)] * 2


def test_region_children_bounds_are_closed(spark):
    df = spark.createDataFrame(
        [
            box(1, 0, (10, 10, 100, 600), persistent=True),
            box(1, 1, (10, 10, 100, 600)),
            box(1, 2, (9, 10, 100, 600)),
            box(1, 3, (20, 300, 40, 320), kind="note"),
            box(1, 4, (20, 300, 40, 320)),
            box(2, 5, (20, 300, 40, 320)),
            box(1, 6, None),
        ],
        BOX,
    )
    assert sorted(rows(ink.region_children(df), "box_index")) == [(1,), (4,)]


def test_best_stage(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.99), (2, 1, None), (2, 2, 0.4), (2, 3, 0.4), (2, 4, 0.1), (2, 5, 0.8), (3, 1, None)],
        "region_id long, stage long, coverage double",
    )
    got = {r[0]: r[1:] for r in rows(ink.best_stage(df), "region_id", "stages_used", "best_stage", "best_coverage")}
    assert got == {1: (2, 2, 0.9), 2: (4, 2, 0.4), 3: (1, None, None)}


# --- quality ------------------------------------------------------------------------------


def test_density_of_page_without_valid_box(spark):
    df = spark.createDataFrame([box(1, 0, None), box(2, 0, (0, 0, 0, 5), "abc")], BOX)
    assert sorted(rows(Q.page_density(df))) == [(1, 0.0, 0.0, 0.0, 0), (2, 3000.0, 3000.0, 3000.0, 1)]


def test_confirmed_pages(spark):
    df = spark.createDataFrame(
        [box(1, 0, status="confirmed"), box(1, 1, status=None), box(2, 0, kind="note"), box(3, 0, status="auto_confirmed")], BOX
    )
    assert sorted(r[0] for r in rows(Q.confirmed_pages(df, 1.0), "page_id")) == [2, 3]
    assert sorted(r[0] for r in rows(Q.confirmed_pages(df, 0.5), "page_id")) == [1, 2, 3]


def test_skew_angle_folds_and_limits(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 100, 0), (1, 0, 0, 0, 100), (1, 0, 0, 100, 100), (2, 0, 0, 100, 60)], "page_id long, x1 long, y1 long, x2 long, y2 long"
    )
    got = {r[0]: (round(r[1], 3), r[2]) for r in rows(Q.skew_angle(df, df), "page_id", "skew_angle", "line_count")}
    assert got == {1: (0.0, 2), 2: (0.0, 0)}


def test_filter_by_coverage_defaults(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0.75, None)], "page_id long, coverage double, uncovered double")
    assert sorted(rows(Q.filter_by_coverage(df))) == [(1, 0.0, 1.0), (2, 0.75, 0.25)]
    assert rows(Q.filter_by_coverage(df, min_coverage=0.5), "page_id") == [(2,)]


# --- text -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "match", "similarity"),
    [("", "", True, 1.0), ("a b", "ab", True, 1.0), ("abc", "abd", False, 2 / 3), ("abc", "", False, 0.0), ("xabc", "abc", False, 0.0), ("Ä\u00a0b", "Äb", True, 1.0)],
)
def test_compare_texts(spark, a, b, match, similarity):
    got = rows(A.compare_texts(one(spark, "a string, b string", a, b), "a", "b"), "match", "similarity")
    assert got == [(match, pytest.approx(similarity))]


def _differences(x, y):
    out = []
    for i in range(max(len(x), len(y))):
        c, d = x[i : i + 1], y[i : i + 1]
        if c != d:
            base = x if i < len(x) else y
            out.append((i, c, d, base[max(0, i - 10) : i + 10]))
    return out


def test_differences_of_long_texts(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdö😀") for _ in range(70_000))
    other = "".join(c if rnd.random() > 0.01 else "z" for c in long[:65_000])
    cases = [("abcdefghijklmnop", "abcXefghijklmnopqr"), ("", "ab"), ("ab", ""), ("", ""), (long, other)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, a string, b string")
    got = {}
    for r in rows(A.text_differences(df, ["k"], "a", "b"), "k", "position", "char1", "char2", "context"):
        got.setdefault(r[0], []).append(r[1:])
    for i, (a, b) in enumerate(cases):
        assert sorted(got.get(i, [])) == _differences(a, b)


def test_confusion(spark):
    table = T.confusion_table()
    assert (table["r"], table["O"], table["5"]) == ("imn", "0CGQ", "S")
    df = spark.createDataFrame([(1, "Ox"), (2, ""), (3, " \n"), (4, "xyz")], "k int, t string")
    got = {r[0]: r[1] for r in rows(df.select("k", T.confusion_score("t")))}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    hit = rows(A.confusion_hits(df, ["k"], "t"))
    assert hit == [(1, 0, "O", "0CGQ", "Ox")]


def _window_match(box, native, threshold=0.95):
    if not box or len(box) > len(native):
        return False
    for size in {max(1, len(box) - 1), len(box), min(len(native), len(box) + 1)}:
        for start in range(len(native) - size + 1):
            part = native[start : start + size]
            same = sum(x == y for x, y in zip(box, part, strict=False))
            if box == part or same / max(len(box), size) >= threshold:
                return True
    return False


def test_window_match_against_brute_force(spark):
    rnd = random.Random(11)
    cases = []
    for _ in range(400):
        native = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 120)))
        at = rnd.randint(0, max(0, len(native) - 1))
        piece = list(native[at : at + rnd.randint(0, 60)])
        for _ in range(rnd.randint(0, 4)):
            if piece:
                piece[rnd.randrange(len(piece))] = "z"
        cases.append(("".join(piece), native))
    cases += [("a" * 19 + "b", "a" * 20), ("a" * 20, "a" * 19 + "b" + "a"), ("abc", "ab"), ("", "abc"), ("x", "")]
    want = [_window_match(b, n) for b, n in cases]
    boxes = spark.createDataFrame([(i, 0, c[0]) for i, c in enumerate(cases)], "page_id long, box_index long, text string")
    native = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "page_id long, native_text string")
    got = dict(rows(A.matches_native(boxes, native), "page_id", "matches_native"))
    assert [got[i] for i in range(len(cases))] == want


def _plain_ink(dark, rects):
    return {k: sum(l <= x < r and t <= y < b for x, y in dark) for k, (l, t, r, b) in rects.items()}


def test_ink_against_every_pixel(spark):
    rnd = random.Random(9)
    width, height = 700, 400
    dark = sorted({(rnd.randrange(width), rnd.randrange(height)) for _ in range(3000)} | {(x, 100) for x in range(width)} | {(width - 1, height - 1), (0, 0)})
    boxes = []
    for k in range(60):
        x, y = rnd.randint(-20, width), rnd.randint(-20, height)
        boxes.append((1, k, x, y, x + rnd.choice([0, 1, 63, 64, 65, 300, -5]), y + rnd.choice([0, 1, 31, 32, 33, 200])))
    boxes += [(1, 60, None, 1, 2, 3), (2, 0, 0, 0, 50, 50), (1, 61, 0, 0, 64, 32), (1, 62, 640, 384, 700, 400)]
    d = spark.createDataFrame([(1, x, y) for x, y in dark], "page_id long, x long, y int")
    b = spark.createDataFrame([(*r, "ab") for r in boxes], "page_id long, box_index long, x1 int, y1 int, x2 int, y2 int, text string")
    whole = [r for r in boxes if None not in r and r[0] == 1]
    cut = {k: (max(0, min(x1, width)), max(0, min(y1, height)), max(0, min(x2, width)), max(0, min(y2, height))) for _, k, x1, y1, x2, y2 in whole}
    left = [(x, y) for x, y in dark if not any(l <= x < r and t <= y < e for l, t, r, e in cut.values())]
    assert sorted(tuple(r) for r in ink.uncovered_pixels(d, b, width, height).collect()) == [(1, x, y) for x, y in left]
    got = ink.page_coverage(d, b, width, height).collect()
    assert [(r["total_dark"], r["uncovered_dark"]) for r in got] == [(len(dark), len(left))]
    crops = b.where(G.has_corners()).withColumns(G.crop_bounds(width, height, 3)).where("cx1 <= cx2 and cy1 <= cy2 and page_id = 1").collect()
    want = _plain_ink(dark, {r["box_index"]: (r["cx1"], r["cy1"], r["cx2"], r["cy2"]) for r in crops})
    got = ink.box_black_pixels(b, d, width, height, 3).where("page_id = 1").collect()
    assert {r["box_index"]: r["black_pixels"] for r in got} == want


def test_equal_boxes_on_one_tile_do_not_multiply_pixels(spark):
    dark = spark.range(4096).selectExpr("1L AS page_id", "id % 128 AS x", "id DIV 128 AS y")
    boxes = spark.range(1000).selectExpr("1L AS page_id", "id AS box_index", "0 AS x1", "0 AS y1", "120 AS x2", "30 AS y2", "'a' AS text")
    rects = ink._page_rects(boxes, 1000, 1600, ["page_id", "box_index"])
    assert ink._explode_tiles(rects).join(ink._tiles(dark), ink._TILE).count() == 1000
    covered = ink._covered(rects.drop("box_index"), dark, ["page_id"])
    assert covered.count() == 30 * 2
    got = ink.box_black_pixels(boxes, dark, 1000, 1600, 0)
    crop = boxes.withColumns(G.crop_bounds(1000, 1600, 0)).first()
    assert {r["black_pixels"] for r in got.collect()} == {
        (min(crop["cx2"], 128) - crop["cx1"]) * (min(crop["cy2"], 32) - crop["cy1"])
    }


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95, 1.0])
def test_native_match_of_long_and_short_texts(spark, monkeypatch, threshold, few):
    monkeypatch.setattr(A, "FEW", few)
    rnd = random.Random(int(100 * threshold) + few)
    pages = {p: "".join(rnd.choice("abcdefgh é") for _ in range(n)) for p, n in ((1, 700), (2, 129), (3, 9), (4, 0), (5, 5_000))}
    pages[6] = "ab" * 300  # the same seeds everywhere
    boxes = [(None, "abc"), (9, "abc"), (4, "abc"), (1, None), (1, " \n"), (6, "ab" * 60 + "b" * 3), (6, "ba" * 11)]
    for p, text in pages.items():
        for _ in range(25 if len(text) > 9 else 4):
            at, n = rnd.randint(0, max(0, len(text) - 1)), rnd.choice([1, 2, 5, 9, 10, 19, 20, 39, 150, 400])
            piece = list(text[at : at + n]) + ["x"] * rnd.choice([0, 0, 1])
            for _ in range(rnd.choice([0, 0, 1, len(piece) // 20, len(piece) // 20 + 1])):
                if piece:
                    piece[rnd.randrange(len(piece))] = "z"
            boxes.append((p, "".join(piece)))
    rows_ = [(p, i, t, "n") for i, (p, t) in enumerate(boxes)]
    got = A.matches_native(
        spark.createDataFrame(rows_, "page_id long, box_index long, text string, native_text string"),
        spark.createDataFrame(list(pages.items()), "page_id long, native_text string"),
        threshold=threshold,
    )
    assert got.columns == ["page_id", "box_index", "text", "native_text", "matches_native"]

    def squeezed(t):
        return "".join((t or "").split())

    want = {i: _window_match(squeezed(t), squeezed(pages.get(p)), threshold) for p, i, t, _ in rows_}
    assert {r["box_index"]: r["matches_native"] for r in got.collect()} == want


def test_similarity_of_long_texts(spark):
    rnd = random.Random(2)
    a = "".join(rnd.choice("ab é\n") for _ in range(150_000))
    b = "".join(c if rnd.random() > 0.01 else "z" for c in a)[:140_000]
    df = spark.createDataFrame([(1, a, b), (2, "", ""), (3, None, "x"), (4, "a b", "ab"), (5, b, a)], "k int, x string, y string")
    got = {r["k"]: (r["match"], r["similarity"]) for r in A.compare_texts(df, "x", "y").collect()}

    def want(x, y):
        x, y = "".join(x.split()), "".join(y.split())
        return x == y, sum(c == d for c, d in zip(x, y, strict=False)) / max(len(x), len(y))

    assert got == {1: want(a, b), 2: (True, 1.0), 3: (False, 0.0), 4: (True, 1.0), 5: want(b, a)}


def test_differences_of_new_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, "new"), (1, 1, "pending"), (1, 2, "new"), (2, 0, None)], "page_id long, box_index long, review_status string")
    texts = [(1, 0, "ab c", "axc!"), (1, 1, "a", "b"), (1, 2, "", "b"), (2, 0, "a", "b"), (3, 0, "a", "b")]
    engines = spark.createDataFrame(texts, "page_id long, box_index long, classic_text string, vision_text string")
    got = rows(R.review_differences(boxes, engines))
    assert sorted(got) == [(1, 0, 1, "b", "x", "abc"), (1, 0, 3, "", "!", "axc!")]


def test_slug_and_snippet(spark):
    df = spark.createDataFrame([("  Dr. Müller -- Lüd  ",), ("ÄÖ",), ("a_b c",)], "n string")
    assert rows(df.select(T.slug("n"))) == [("dr-mller-ld",), ("",), ("ab-c",)]
    text = "x" * 200 + "Treffer" + "y" * 200
    df = one(spark, "t string, s string", text, "kurz")
    got = rows(df.select(T.snippet("t", F.lit("treffer"), "s"), T.snippet("t", F.lit("fehlt"), "s"), T.snippet("t", F.lit("fehlt")), T.snippet(F.lit(""), F.lit("x"))))[0]
    assert got == ("…" + "x" * 120 + "Treffer" + "y" * 120 + "…", "kurz", text[:240], "")


def test_scores(spark):
    df = spark.createDataFrame([(None,), (9.0,), (18.0,), (35.0,), (43.75,), (60.0,)], "v double")
    assert [r[0] for r in rows(df.select(S.ink_score(F.col("v"))))] == pytest.approx([0, 0.5, 1, 1, 0.5, 0])
    df = one(spark, "m double, t double, c double", 2.0, -1.0, 0.5)
    assert rows(df.select(S.combined_score(F.col("m"), F.col("t"), F.col("c"))))[0][0] == pytest.approx(0.8)
    df = spark.createDataFrame([(0.8, True, None), (0.8, True, 50.0), (0.8, False, 20.0), (None, True, 20.0)], "c double, f boolean, i double")
    got = rows(df.select(S.auto_confirm(F.col("c"), F.col("f"), F.col("i"), 0.7, 18, 35)))
    assert got == [(True,), (False,), (False,), (False,)]


# --- units ---------------------------------------------------------------------------------------


def _pairs(flags):
    out, i = [], 0
    while i < len(flags):
        if flags[i] and i + 1 < len(flags):
            out.append((i, i + 1))
            i += 2
        else:
            out.append((i, None))
            i += 1
    return out


def test_pair_pages_against_a_sequential_loop(spark):
    rnd = random.Random(1)
    # a missing flag means no
    runs = {d: [None if rnd.random() < 0.02 else rnd.random() < p for _ in range(n)] for d, (n, p) in enumerate([(1, 1), (2, 1), (7, 0.9), (40, 0.5), (9000, 0.97), (5, 0), (6, 1)])}
    # the first page of a document may have no number
    data = [(d, 10 + 3 * i if i else None, i, f) for d, flags in runs.items() for i, f in enumerate(flags)]
    df = spark.createDataFrame(data, "document_id long, page_number long, page_id long, belongs_with_next boolean")
    got = {}
    for d, first, second in rows(U.pair_pages(df), "document_id", "first_page", "second_page"):
        got.setdefault(d, []).append((first, second))
    assert {d: sorted(v, key=lambda t: t[0]) for d, v in got.items()} == {d: _pairs(f) for d, f in runs.items()}


def test_featured_unit_levels(spark):
    schema = "unit_id long, is_public boolean, year long, summary string"
    persons = spark.createDataFrame([(2, 1, "Zweite"), (2, 0, ""), (3, 0, "Anna B")], "unit_id long, pos long, name string")
    units = spark.createDataFrame([(1, True, 1950, "s"), (2, True, 1990, None), (3, True, 1960, "t"), (4, False, 2000, "u")], schema)
    assert rows(U.featured_unit(units, persons), "unit_id", "person_slug") == [(3, "anna-b")]
    assert rows(U.featured_unit(units.withColumn("summary", F.lit("")), persons), "unit_id") == [(3,)]
    assert rows(U.featured_unit(units.where("not is_public"), persons)) == []


def test_merge_pages_reports_a_missing_page(spark):
    pages = spark.createDataFrame([(1, 5), (2, 3)], "page_id long, page_number long")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "page_id long")
    assert rows(U.merge_pages(pages, ids, 7, "b.pdf"), "error") == [("not all pages found",)]
    got = rows(U.merge_pages(pages, ids.where("page_id < 9"), 7, "b.pdf"), "is_composite", "page_number", "page_id")
    assert sorted(got, key=str) == sorted([(1, None, None), (0, 1, 2), (0, 2, 1)], key=str)


def test_assign_notes_with_no_ids_changes_nothing(spark):
    notes = spark.createDataFrame([(1, "note", 5), (2, "note", None), (3, "ocr", None)], "note_id long, box_type string, story_id long")
    none = spark.createDataFrame([], "note_id long")
    assert sorted(rows(U.assign_notes(notes, 5, none), "note_id", "story_id"), key=str) == [(1, 5), (2, None), (3, None)]
    some = spark.createDataFrame([(2,), (3,)], "note_id long")
    assert sorted(rows(U.assign_notes(notes, 5, some), "note_id", "story_id"), key=str) == [(1, None), (2, 5), (3, None)]


# --- jobs and review -------------------------------------------------------------------------------

STATES = ("pending", "running", "completed", "failed", "cancelled", "paused", "archived")


@pytest.mark.parametrize("action", list(J.TRANSITIONS))
def test_job_transitions(spark, action):
    jobs = spark.createDataFrame([(i, s) for i, s in enumerate(STATES)], "id long, status string")
    ids = jobs.select("id").unionByName(spark.createDataFrame([(99,)], "id long"))
    now = F.current_timestamp()
    after = dict(rows(J.apply_job_action(jobs, ids, action, now), "id", "status"))
    allowed, target = J.TRANSITIONS[action]
    want = {i: (target if s in allowed else s) for i, s in enumerate(STATES) if not (target is None and s in allowed)}
    assert after == want
    refused = {r[0] for r in rows(J.rejected_actions(jobs, ids, action), "id")}
    assert refused == {99} | {i for i, s in enumerate(STATES) if s not in allowed}


def test_edit_without_refs_or_filters_changes_nothing(spark):
    df = spark.createDataFrame([box(1, 0), box(1, 1)], BOX)
    chosen = R.select_boxes(df)
    assert chosen.count() == 0
    out = R.change_status(df, chosen, "confirmed", F.current_timestamp())
    assert {r[0] for r in rows(out, "review_status")} == {"new"}
    with pytest.raises(ValueError):
        R.change_status(df, chosen, "done", F.current_timestamp())


def test_apply_review_error_leaves_box_pending_and_empty(spark):
    df = spark.createDataFrame([box(1, 0, text="alt"), box(1, 1, text="alt"), box(1, 2, text="alt", status="confirmed"), box(1, 3, text="alt")], BOX)
    engines = spark.createDataFrame(
        [(1, 0, "a b", None, "ab", None), (1, 1, "x", None, None, None), (1, 2, "x", None, "x", None), (1, 3, "t", None, " ", None)],
        "page_id long, box_index long, classic_text string, classic_error string, vision_text string, vision_error string",
    )
    got = {r[0]: r[1:] for r in rows(R.apply_review(df, engines, F.current_timestamp()), "box_index", "text", "review_status")}
    assert got == {0: ("ab", "auto_confirmed"), 1: ("", "pending"), 2: ("alt", "confirmed"), 3: ("t", "pending")}


# --- people and graph ---------------------------------------------------------------------------------


def test_timeline_range_without_end(spark):
    ev = spark.createDataFrame(
        [(1, 5, "Person_1", "board", "2000-01-01", None), (2, 5, "Person_1", "gast", "2001-01-01", None), (3, 5, "Person_2", "unbekannt", None, "2002-01-01"), (4, 5, "Place_1", "board", None, None)],
        "id long, page_id long, entity_uri string, event_type string, start_date string, end_date string",
    ).withColumns({c: F.to_timestamp(c) for c in ("start_date", "end_date")})
    names = spark.createDataFrame([("Person_1", "Zoe")], "entity_uri string, name string")
    got = rows(PE.person_timeline(ev, names), "id", "kind", "sort_rank", "person_name", F.year("end"))
    assert got == [(1, "range", 2, "Zoe", 2000), (2, "point", 2, "Zoe", None), (3, "point", 999, "", 2002)]


TRIPLES = "subject string, predicate string, object string, object_type string"


def test_upsert_place_loses_fields_but_keeps_the_image(spark):
    old = spark.createDataFrame(
        [("Place_1", "name", "A", "literal"), ("Place_1", "lat", "1", "literal"), ("Place_1", "mainImage", "i.jpg", "literal"), ("Place_2", "lat", "2", "literal")], TRIPLES
    )
    new = spark.createDataFrame(
        [("Place_1", "B", None, None, False, None, "7", None, None, None)],
        "entity_uri string, name string, wikidata_id string, main_image_url string, update_main_image boolean, lat string, lon string, historical_address string, adressbuch_url string, adressbuch_page string",
    )
    got = sorted(rows(GR.upsert_place(old, new), "subject", "predicate", "object"))
    assert got == [("Place_1", "lon", "7"), ("Place_1", "mainImage", "i.jpg"), ("Place_1", "name", "B"), ("Place_2", "lat", "2")]


def test_match_authority_prefers_exact_names(spark):
    e = one(spark, "entity_id long, name string, context string, kind string", 1, "Dresden", "Elbe", "place")
    c = spark.createDataFrame(
        [("Q1", "Dresden", "Stadt an der Elbe"), ("Q2", "Neu Dresden", "Ort"), ("Q3", "Berlin", "Stadt"), ("Q4", "dresden", "Film")],
        "id string, label string, description string",
    )
    got = [(r[0], round(r[1], 2)) for r in sorted(rows(match_authority(e, c), "candidate_id", "score", "rank"), key=lambda t: t[2])]
    assert got == [("Q1", 0.8), ("Q4", 0.5), ("Q2", 0.4)]


def test_match_authority_against_all_pairs(spark):
    rnd = random.Random(7)
    texts = ["", "a", "Bach", "Offenbach", "bach am Main", "Ach", "ff", "Main", "AM", "Dresden"]
    descriptions = ["", "Stadt in Hessen", "Verein", "Person", "Ort am Main", "Club in hessen"]
    e = [(i, rnd.choice(texts), rnd.choice(["", "Hessen", "main", "x"]), rnd.choice(["place", "person", "other"])) for i in range(60)]
    c = [(f"Q{i:03}", rnd.choice(texts), rnd.choice(descriptions)) for i in range(90)]
    ef = spark.createDataFrame(e, "entity_id long, name string, context string, kind string")
    cf = spark.createDataFrame(c, "id string, label string, description string")
    pairs = ef.join(cf, F.contains(F.lower("label"), F.lower("name")) | F.contains(F.lower("name"), F.lower("label")))
    score = GR.match_score(*[F.col(x) for x in ("name", "label", "description", "context", "kind")])
    best = {}
    for i, q, s in rows(pairs.withColumn("s", score), "entity_id", "id", "s"):
        best.setdefault(i, []).append((-s, q))
    want = sorted((i, q, k + 1) for i, v in best.items() for k, (_, q) in enumerate(sorted(v)[:10]))
    assert sorted(rows(match_authority(ef, cf), "entity_id", "candidate_id", "rank")) == want


def test_resolve_labels_fall_back(spark):
    ids = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")
    labels = spark.createDataFrame([("Q1", "de", "eins"), ("Q1", "en", "one"), ("Q2", "en", "two"), ("Q3", "fr", "trois")], "id string, language string, label string")
    assert dict(rows(C.resolve_labels(ids, labels), "id", "label")) == {"Q1": "eins", "Q2": "two", "Q3": "Q3"}


# --- parsing, web, sources ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"corrected_text": " a ", "confidence": 0.7, "auto_confirm": true}', ("a", 0.7, True, "")),
        ('{"corrected_text": "a", "confidence": "hoch", "auto_confirm": 0, "reason": "r"}\nMehr', ("a", 0.9, False, "r")),
        ('So: ```json\n{"corrected_text": "a"}\n``` fertig', ("a", 0.5, False, "")),
        ('Vorweg {"corrected_text": "{a}", "confidence": 7} danach', ("{a}", 1.0, False, "")),
        ('{"text": "a"}', (None, None, None, None)),
        ("kein JSON", (None, None, None, None)),
        ("", (None, None, None, None)),
    ],
)
def test_parse_review_json(spark, answer, want):
    got = rows(P.parse_review_json(one(spark, "a string", answer), "a"), "corrected_text", "confidence", "auto_confirm", "reason")
    assert got == [want]


def test_parse_unit_json(spark):
    df = spark.createDataFrame(
        [('x {"summary": " s ", "topic": "", "persons": [{"name": "A ", "role": "Referent"}, {"role": "x"}, "B", {"name": "C", "role": "y"}], "belongs_with_next": 1} {"b": 2}',), ("nichts {",), ("[1]",)],
        "a string",
    )
    got = rows(P.parse_unit_json(df, "a"), "summary", "topic", "belongs_with_next", "persons", "extracted_names")
    assert got[0] == ("s", None, True, [("A", "Referent"), ("C", "andere")], [])
    assert got[1] == got[2] == (None,) * 5


def test_explode_boxes_guards(spark):
    df = spark.createDataFrame(
        [(1, '[{"text": "a", "bbox_pixel": [1, 2, 3, 4], "reviewed_at": "2024-01-02T03:04:05Z"}, 5, {"box_type": "", "bbox_pixel": [1]}]'), (2, "[{"), (3, '{"text": "a"}'), (4, None), (5, "")],
        "id long, bbox_data string",
    )
    got = rows(archive.explode_boxes(df), "ocr_result_id", "box_index", "pos", "text", "box_type", "x2", "reviewed_at")
    assert [g[:6] for g in got] == [(1, 0, 0, "a", "ocr", 3), (1, 1, 2, None, "ocr", None)]
    assert str(got[0][6]) == "2024-01-02 03:04:05"


def test_native_text_boxes(spark):
    df = spark.createDataFrame([(1, " Hello PDF Text\n", 10, 20), (2, " \n", 10, 20), (3, None, 10, 20)], "page_id long, text string, width int, height int")
    assert rows(archive.native_text_boxes(df), "page_id", "text", "bbox", "x2", "y2") == [(1, "Hello PDF Text", [0.0, 0.0, 1.0, 1.0], 10, 20)]


def test_parse_grounding(spark):
    mark = "<|ref|>{}<|/ref|><|det|>[[{}]]<|/det|>{}"
    text = "\n".join(
        [mark.format("a", "1, 2, 3,4", "\nnach"), mark.format("b", "0,0,0,0", ""), mark.format(" c ", "0, 0, 0, 5", ""), mark.format("d", "1,5,9,5", ""), mark.format("e", "5,1,2,9", "")]
    )
    df = spark.createDataFrame([(1, text, 100, 200), (2, "nichts", 1, 1)], "page_id long, answer string, width long, height long")
    got = rows(grounding.parse_grounding(df), "det_index", "text", "x1", "y1", "x2", "y2", "rel_x2")
    assert got == [(0, "nach", 1, 2, 3, 4, 0.03), (2, "c", 0, 0, 100, 5, 1.0)]


def test_triple_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("s1", "p", "http://x/y", "uri"), ("s1", "p", 'a "q" \\ b\nc\tö', "literal"), ("s1", "p", "C:\\neu", "literal"), ("s1", "p", "C:\\neu", "literal")], TRIPLES
    )
    ntriples.write_triples(df, str(tmp_path / "t"))
    assert sorted(rows(ntriples.read_triples(spark, str(tmp_path / "t")))) == sorted(set(rows(df)))
    lines = spark.createDataFrame([("# c",), ('<a> <b> "x"@de .',), ('<a> <b> "1"^^<http://int> .',), ("<a> <b> c .",)], "value string")
    assert sorted(rows(ntriples.parse_ntriples(lines), "object")) == [("1",), ("x",)]


def test_web(spark):
    df = one(spark, "k int, h string", 1, '<a href="/x">eins <b>b</b></a><a href="/X">zwei</a><a href="rel">r</a><a href="/login">l</a><a href="/leer"> </a>')
    assert sorted(rows(W.html_links(df, ["k"], "h", "https://s.de", deny=["/login"]))) == [(1, 0, "https://s.de/x", "eins b"), (1, 2, "rel", "r")]
    df = one(spark, "k int, j string", 1, '{"http://k.png": ["http:\\/\\/a/b.JPG", {"x": "https://h/iiif/1"}], "z": "ftp://a.png", "e": "q\\"http://no"}')
    assert sorted(rows(W.image_urls_in_json(df, ["k"], "j"))) == [(1, "http://a/b.JPG"), (1, "https://h/iiif/1")]
    df = spark.createDataFrame([("64, 8,8,x,-1",), ("",), (None,)], "s string")
    assert rows(df.select(W.variant_sizes(F.col("s")))) == [([8, 64],), ([64, 128, 256, 512],), ([64, 128, 256, 512],)]


# --- shared places, stored triples ------------------------------------------------------


def test_classes_of_shared_places_hold_all_pairs(spark):
    rng = random.Random(5)
    seen = [(rng.randrange(60), f"Person_{rng.randrange(6)}") for _ in range(150)]
    seen += [(k, f"Person_{j}") for k in range(100, 400) for j in range(3)]  # one set of people in very many places
    seen += [(None, "Person_1"), (None, "Person_2"), (1000, "Place_1"), (1000, "Person_1")]
    df = spark.createDataFrame(seen, "source_box long, entity_uri string")
    places = {}
    for at, who in set(seen):
        if at is not None and who.startswith("Person_"):
            places.setdefault(at, set()).add(who)
    want = {}
    for people in places.values():
        for a in people:
            for b in people - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    classes = {}
    for class_id, n, people, who in rows(PE.co_mention_classes(df), "class_id", "places", "people", "entity_uri"):
        classes.setdefault((class_id, n, people), []).append(who)
    got = {}
    for (_, n, people), members in classes.items():
        assert len(members) == people
        for a in members:
            for b in set(members) - {a}:
                got[a, b] = got.get((a, b), 0) + n
    assert got == want
    assert sum(map(len, classes.values())) <= len(set(seen)) // 3
    assert PE.co_mention_classes(df.limit(0)).count() == 0


def test_fresh_triples_join_a_stored_set(spark):
    kind = "subject string, predicate string, object string, object_type string"
    stored = spark.createDataFrame([("a", "p", "x", "uri"), ("b", "p", None, "uri")], kind)
    fresh = spark.createDataFrame([("a", "p", "x"), ("c", "p", "y"), ("c", "p", "y"), ("b", "p", None)], "subject string, predicate string, object string")
    got = sorted(rows(GR.add_triples(stored, fresh)), key=str)
    assert got == sorted([("a", "p", "x", "uri"), ("b", "p", None, "uri"), ("c", "p", "y", "uri")], key=str)


def test_statement_with_several_values_gives_all_combinations(spark):
    data = [("s", "statementSubject", "a"), ("s", "statementSubject", "b"), ("s", "statementPredicate", "p"), ("s", "statementObject", "o")]
    data += [("s", "belegtIn", "q"), ("t", "statementSubject", "a"), ("t", "statementPredicate", "p")]
    df = spark.createDataFrame([(*d, "uri") for d in data], "subject string, predicate string, object string, object_type string")
    assert sorted(rows(GR.statements(df))) == [("s", "a", "p", "o", "q"), ("s", "b", "p", "o", "q")]
