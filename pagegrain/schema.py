"""Declared schemas of the archive tables and their value lists."""

from __future__ import annotations

# Columns of the archive tables.
SCHEMAS = {
    "documents": (
        "id BIGINT, filename STRING, file_path STRING, file_type STRING, file_size BIGINT, "
        "parent_document_id BIGINT, is_composite INT, page_number INT, document_type STRING, "
        "title STRING, date TIMESTAMP, status STRING, created_at TIMESTAMP"
    ),
    "pages": (
        "id BIGINT, document_id BIGINT, page_number INT, file_path STRING, file_type STRING, "
        "is_extracted BOOLEAN, deskew_angle DOUBLE, date TIMESTAMP, created_at TIMESTAMP"
    ),
    "results": (
        "id BIGINT, document_id BIGINT, document_page_id BIGINT, source STRING, text STRING, "
        "confidence DOUBLE, image_width INT, image_height INT, bbox_data STRING, "
        "has_metrics BOOLEAN, created_at TIMESTAMP"
    ),
    "boxes": (
        "id BIGINT, ocr_result_id BIGINT, box_type STRING, bbox ARRAY<DOUBLE>, bbox_pixel ARRAY<INT>, "
        "text STRING, reviewed_text STRING, persistent_multibox_region BOOLEAN, review_status STRING, "
        "reviewed_at TIMESTAMP, reviewed_by STRING, deskew_angle DOUBLE, note_author STRING, "
        "note_text STRING, story_id BIGINT, char_count INT, chars_per_1k_px DOUBLE, area_px BIGINT, "
        "black_pixels BIGINT, black_pixels_per_char DOUBLE, left_pct DOUBLE, right_pct DOUBLE, "
        "width_pct DOUBLE, metrics_stale BOOLEAN"
    ),
    "dark_px": "page_id BIGINT, x INT, y INT",
    "line_segments": "page_id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT",
    "units": (
        "id BIGINT, document_id BIGINT, page_ids ARRAY<BIGINT>, belongs_with_next BOOLEAN, "
        "is_public BOOLEAN, document_type STRING, title STRING, date TIMESTAMP, summary STRING, "
        "persons ARRAY<STRUCT<name STRING, role STRING>>, topic STRING, place STRING, "
        "event_date STRING, extracted_phrases ARRAY<STRING>, extracted_names ARRAY<STRING>"
    ),
    "mention_boxes": (
        "id BIGINT, document_page_id BIGINT, box_type STRING, entity_type STRING, entity_uri STRING, "
        "name STRING, event_type STRING, start_date TIMESTAMP, end_date TIMESTAMP, "
        "subject_uri STRING, predicate_uri STRING, object_uri STRING"
    ),
    "triples": "subject STRING, predicate STRING, object STRING, object_type STRING",
    "jobs": (
        "id BIGINT, document_id BIGINT, document_page_id BIGINT, status STRING, job_type STRING, "
        "priority INT, progress DOUBLE, current_step STRING, error_message STRING, job_params STRING, "
        "created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP"
    ),
    "stories": (
        "id BIGINT, slug STRING, title STRING, epoch STRING, is_published BOOLEAN, "
        "is_featured BOOLEAN, updated_at TIMESTAMP"
    ),
    "authority": "id STRING, label STRING, description STRING",
}

# Kinds of boxes and sources.
BOX_TYPES = ("ocr", "manual", "ignore_region", "note")
SOURCES = ("tesseract", "pdf_native", "ollama_vision")
