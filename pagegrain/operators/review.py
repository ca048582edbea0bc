"""Batch edits of the box table: table in, new table out.

Time stamps are parameters.  ``touched_pages`` gives the pages whose metrics
an edit makes stale; it feeds ``jobs.pages_needing_job``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import scores
from pagegrain.functions import text as T
from pagegrain.operators import boxes as B
from pagegrain.operators import spread

KEY = ["page_id", "box_index"]

# Review states a batch edit may set, and those of a single edit.
BATCH_STATES = ("pending", "confirmed", "rejected", "auto_confirmed", "ignored", "new")
STATES = (*BATCH_STATES, "ocr_done")


def select_boxes(boxes: DataFrame, refs: DataFrame | None = None, **filters) -> DataFrame:
    """Keys of the boxes an edit applies to: explicit refs win over filters; neither gives none."""
    if refs is not None:
        return boxes.join(refs.select(*KEY).distinct(), KEY, "left_semi").select(*KEY)
    if any(v is not None for v in filters.values()):
        return B.filter_boxes_lenient(boxes, **filters).select(*KEY)
    return boxes.select(*KEY).where(F.lit(False))


def chosen_boxes(boxes: DataFrame, refs: DataFrame | None = None, **filters) -> DataFrame | Column:
    """As ``select_boxes``, but filters stay a condition on the row, so that the edit reads the table once."""
    if refs is None and any(v is not None for v in filters.values()):
        return B.lenient_condition(boxes, **filters)
    return select_boxes(boxes, refs, **filters)


def bad_refs(boxes: DataFrame, refs: DataFrame) -> DataFrame:
    """Refs that name no box, with the reason."""
    pages = boxes.select("page_id").distinct().withColumn("_page", F.lit(True))
    return (
        refs.select(*KEY)
        .distinct()
        .join(boxes.select(*KEY), KEY, "left_anti")
        .join(pages, "page_id", "left")
        .select(
            *KEY,
            F.when(F.col("_page"), "box index out of range").otherwise("no boxes on this page").alias("error"),
        )
    )


def touched_pages(chosen: DataFrame) -> DataFrame:
    return chosen.select("page_id").distinct()


def _mark(boxes: DataFrame, chosen: DataFrame | Column) -> DataFrame:
    """Mark the chosen rows; a condition on the row itself needs no join."""
    if isinstance(chosen, Column):
        return boxes.withColumn("_hit", F.coalesce(chosen, F.lit(False)))
    return boxes.join(chosen.select(*KEY).withColumn("_hit", F.lit(True)), KEY, "left").withColumn(
        "_hit", F.coalesce("_hit", F.lit(False))
    )


def _set(marked: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Give the chosen rows new values; unknown columns start as null."""
    out = {}
    for name, value in values.items():
        old = F.col(name) if name in marked.columns else F.lit(None)
        out[name] = F.when(F.col("_hit"), value).otherwise(old)
    return marked.withColumns(out).drop("_hit")


def change_status(boxes: DataFrame, chosen: DataFrame | Column, status: str, now: Column) -> DataFrame:
    """M1: set the review status; pending and new clear the review time, others set it."""
    if status not in BATCH_STATES:
        raise ValueError(f"unknown review status: {status}")
    cleared = status in ("pending", "new")
    none = F.lit(None)
    return _set(
        _mark(boxes, chosen),
        {
            "review_status": F.lit(status),
            "reviewed_at": none.cast("timestamp") if cleared else now,
            "reviewed_by": none.cast("string"),
        },
    )


def set_state(boxes: DataFrame, page_id: int, box_index: int, status: str, now: Column) -> DataFrame:
    """M4: confirm, reject or ignore one box."""
    return change_status(boxes, (F.col("page_id") == page_id) & (F.col("box_index") == box_index), status, now)


def discard_and_requeue(boxes: DataFrame, chosen: DataFrame | Column) -> DataFrame:
    """M2: empty the chosen boxes and set them to new."""
    return _set(
        _mark(boxes, chosen),
        {
            "text": F.lit(""),
            "review_status": F.lit("new"),
            "reviewed_at": F.lit(None).cast("timestamp"),
            "reviewed_by": F.lit(None).cast("string"),
        },
    )


def requeue_jobs(chosen: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """M2: one review job of priority -1 per touched page that has none active."""
    from pagegrain.operators.jobs import new_jobs, pages_needing_job

    touched = pages.join(touched_pages(chosen), "page_id", "left_semi")
    return new_jobs(pages_needing_job(touched, jobs, "bbox_review"), "bbox_review", -1)


def delete_boxes(boxes: DataFrame, chosen: DataFrame) -> DataFrame:
    """M3: drop the chosen boxes; the indexes of the rest of their pages close up, other pages stay as they are."""
    pages = touched_pages(chosen)
    kept = boxes.join(chosen.select(*KEY), KEY, "left_anti").join(pages, "page_id", "left_semi")
    renumbered = spread.row_numbers(
        kept.withColumnRenamed("box_index", "_old"), ["page_id"], [F.col("_old")], "box_index", start=0
    )
    return boxes.join(pages, "page_id", "left_anti").unionByName(renumbered.select(*boxes.columns))


def set_text(boxes: DataFrame, texts: DataFrame, now: Column, confirm: bool = False) -> DataFrame:
    """M5: ``texts(page_id, box_index, new_text)`` replace the box texts, optionally confirming."""
    marked = boxes.join(
        texts.select(*KEY, "new_text").withColumn("_hit", F.lit(True)), KEY, "left"
    ).withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    values = {"text": F.col("new_text")}
    if confirm:
        values |= {
            "review_status": F.lit("confirmed"),
            "reviewed_at": now,
            "reviewed_by": F.lit(None).cast("string"),
        }
    return _set(marked, values).drop("new_text")


def update_boxes(boxes: DataFrame, patches: DataFrame, width: Column | int, height: Column | int, now: Column) -> DataFrame:
    """M6: patch coordinates, note fields (on notes only), status and text.

    ``patches`` has the key and nullable ``p_x1..p_y2, p_note_author,
    p_note_text, p_status, p_text``.  Degenerate rectangles and unknown states
    are ignored; relative coordinates are recomputed.
    """
    b = boxes.join(patches, KEY, "left")
    good = (F.col("p_x1") < F.col("p_x2")) & (F.col("p_y1") < F.col("p_y2"))
    status = F.when(F.col("p_status").isin(*STATES), F.col("p_status"))
    note = F.col("box_type") == "note"
    corners = {c: F.coalesce(F.when(good, F.col(f"p_{c}")), F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    has_time = "reviewed_at" in boxes.columns
    old_time = F.col("reviewed_at") if has_time else F.lit(None).cast("timestamp")
    out = b.withColumns(
        {
            **corners,
            "text": F.coalesce("p_text", "text"),
            "reviewed_at": F.when(status.isin("confirmed", "rejected"), now).otherwise(old_time),
            "review_status": F.coalesce(status, F.col("review_status")),
            **{
                c: F.when(note & F.col(f"p_{c}").isNotNull(), F.col(f"p_{c}")).otherwise(
                    F.col(c) if c in boxes.columns else F.lit(None).cast("string")
                )
                for c in ("note_author", "note_text")
            },
        }
    )
    sizes = {"x": width, "y": height}
    out = out.withColumns(
        {
            f"rel_{c}": F.col(c) / (F.lit(sizes[c[0]]) if isinstance(sizes[c[0]], int) else sizes[c[0]])
            for c in ("x1", "y1", "x2", "y2")
        }
    )
    return out.drop(*[c for c in patches.columns if c.startswith("p_")])


def add_boxes(boxes: DataFrame, fresh: DataFrame) -> DataFrame:
    """M7: append boxes after the last of their page, with the defaults of their type.

    ``fresh(page_id, seq, box_type, x1..y2, note_author, note_text)``; ``seq``
    orders new boxes of one page.
    """
    last = boxes.groupBy("page_id").agg(F.max("box_index").alias("_last"))
    kind = F.coalesce(F.nullif(F.col("box_type"), F.lit("")), F.lit("ocr"))
    ignored, note = kind == "ignore_region", kind == "note"
    placed = spread.row_numbers(fresh, ["page_id"], [F.col("seq")], "_k")
    rows = placed.join(last, "page_id", "left").select(
        "page_id",
        (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_k")).alias("box_index"),
        F.when(kind == "manual", "ocr").otherwise(kind).alias("box_type"),
        "x1", "y1", "x2", "y2",
        F.when(ignored, T.IGNORE_MARK).otherwise("").alias("text"),
        F.when(ignored, "ignored").when(note, F.lit(None)).otherwise("new").alias("review_status"),
        *[F.when(note, F.col(c)).alias(c) for c in ("note_author", "note_text")],
    )
    return boxes.unionByName(rows, allowMissingColumns=True)


def apply_review(boxes: DataFrame, engines: DataFrame, now: Column, native: DataFrame | None = None) -> DataFrame:
    """Merge engine results into boxes that still are ``new``.

    ``engines(page_id, box_index, classic_text, classic_error, vision_text,
    vision_error)``; a missing vision result or any error leaves the box
    pending with an empty text, else the final text is set and the box is
    confirmed when the engines agree.
    """
    from pagegrain.operators.agreement import engine_agreement

    # made before the texts are shuffled to their pages, so that the final text goes there and not both engines' texts
    results = engines.withColumns(
        {
            "_failed": F.col("vision_text").isNull() | F.col("vision_error").isNotNull() | F.col("classic_error").isNotNull(),
            "_final": F.when(T.strip(F.coalesce("vision_text", F.lit(""))) != "", T.strip("vision_text")).otherwise(
                T.strip(F.coalesce("classic_text", F.lit("")))
            ),
        }
    )
    judged = engine_agreement(results, native).select(*KEY, "_failed", "_final", "auto_confirmed")
    b = boxes.join(judged, KEY, "left")
    hit = (F.col("review_status") == "new") & F.col("_failed").isNotNull()
    sure = hit & ~F.col("_failed") & F.col("auto_confirmed")
    old_time = F.col("reviewed_at") if "reviewed_at" in boxes.columns else F.lit(None).cast("timestamp")
    return b.withColumns(
        {
            "text": F.when(hit & F.col("_failed"), "").when(hit, F.col("_final")).otherwise(F.col("text")),
            "reviewed_at": F.when(sure, now).otherwise(old_time),
            "review_status": F.when(sure, "auto_confirmed").when(hit, "pending").otherwise(F.col("review_status")),
        }
    ).drop("_failed", "_final", "auto_confirmed")


def review_differences(boxes: DataFrame, engines: DataFrame) -> DataFrame:
    """What a review stores of boxes that still are ``new``: a row per position in which the engines differ.

    Boxes of which one engine has no text have no differences.
    """
    from pagegrain.operators.agreement import agreement_differences

    fresh = boxes.where(F.col("review_status") == "new").select(*KEY)
    return agreement_differences(engines.join(fresh, KEY, "left_semi"), KEY)


def apply_model_review(
    boxes: DataFrame,
    answers: DataFrame,
    now: Column,
    threshold: float,
    ink_low: float | None = None,
    ink_high: float | None = None,
    enabled: bool = True,
) -> DataFrame:
    """Merge parsed model answers: corrected text, a history entry, confirmation by F23.

    ``answers(page_id, box_index, corrected_text, confidence, auto_confirm,
    reason)``; ``boxes`` may have ``black_pixels_per_char`` and a ``reviews`` array.
    """
    b = boxes.join(answers.withColumn("_hit", F.lit(True)), KEY, "left")
    hit = F.coalesce("_hit", F.lit(False))
    ink = F.col("black_pixels_per_char") if "black_pixels_per_char" in boxes.columns else F.lit(None).cast("double")
    sure = hit & F.lit(enabled) & scores.auto_confirm(
        F.col("confidence"), F.col("auto_confirm"), ink, threshold, ink_low, ink_high
    )
    corrected = T.strip(F.coalesce(F.nullif(F.col("corrected_text"), F.lit("")), F.col("text")))
    reason = T.strip(F.coalesce("reason", F.lit("")))
    entry = F.struct(
        F.col("text").alias("original_text"),
        corrected.alias("corrected_text"),
        F.when(reason != "", reason)
        .when(corrected != F.col("text"), "text corrected by model review")
        .otherwise("no change, original confirmed")
        .alias("changes_summary"),
        F.col("confidence").alias("confidence"),
        F.when(sure, "auto_confirmed").otherwise("reviewed").alias("outcome"),
    )
    past = F.col("reviews") if "reviews" in boxes.columns else F.lit(None)
    old_time = F.col("reviewed_at") if "reviewed_at" in boxes.columns else F.lit(None).cast("timestamp")
    reviewed = F.col("reviewed_text") if "reviewed_text" in boxes.columns else F.lit(None).cast("string")
    history = F.when(hit, F.array_append(F.coalesce(past, F.array()), entry)) if "reviews" in boxes.columns else F.when(hit, F.array(entry))
    return b.withColumns(
        {
            "reviews": F.coalesce(history, past) if "reviews" in boxes.columns else history,
            "reviewed_at": F.when(sure, now).otherwise(old_time),
            "review_status": F.when(sure, "auto_confirmed").otherwise(F.col("review_status")),
            "reviewed_text": F.when(hit, corrected).otherwise(reviewed),
            "text": F.when(hit, corrected).otherwise(F.col("text")),
        }
    ).drop("_hit", "corrected_text", "confidence", "auto_confirm", "reason")
