"""Reading archive tables and box lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagegrain.functions import text as T
from pagegrain.functions.parsing import parse_iso
from pagegrain.schema import SCHEMAS


def read_archive(spark: SparkSession, path: str, schema: StructType | str, view: str | None = None) -> DataFrame:
    """Scan a parquet table with its declared schema, optionally as a named view.

    ``schema`` is a table name of ``schema.SCHEMAS``, a DDL string or a StructType.
    """
    if isinstance(schema, str):
        schema = SCHEMAS.get(schema, schema)
    df = spark.read.schema(schema).parquet(path)
    if view is not None:
        df.createOrReplaceTempView(view)
    return df


_TEXT = ("text", "reviewed_text", "review_status", "reviewed_by", "note_author", "note_text")


def explode_boxes(results: DataFrame, key: str = "id", boxes: str = "bbox_data") -> DataFrame:
    """One row per box object of a JSON box list.

    Broken JSON and anything but a list give no rows; entries that are no
    object are dropped.  ``pos`` is the place in the list, ``box_index`` that
    among the boxes kept.
    """
    parsed = F.try_variant_get(F.try_parse_json(boxes), "$", "array<variant>")
    indexed = F.transform(parsed, lambda v, i: F.struct(i.alias("pos"), v.alias("v")))
    kept = F.filter(indexed, lambda s: F.schema_of_variant(s["v"]).startswith("OBJECT"))
    rows = results.select(F.col(key).alias("ocr_result_id"), F.posexplode(kept).alias("_i", "_s")).select(
        "ocr_result_id", F.col("_i").cast("long").alias("box_index"), F.col("_s.pos").cast("long").alias("pos"), F.col("_s.v").alias("_v")
    )

    def get(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    corners = F.when(F.size(get("bbox_pixel", "array<double>")) >= 4, get("bbox_pixel", "array<double>"))
    return rows.select(
        "ocr_result_id",
        "box_index",
        "pos",
        F.coalesce(F.nullif(get("box_type"), F.lit("")), F.lit("ocr")).alias("box_type"),
        get("bbox", "array<double>").alias("bbox"),
        *[corners[i].cast("long").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        *[get(c).alias(c) for c in _TEXT],
        F.coalesce(get("persistent_multibox_region", "boolean"), F.lit(False)).alias("persistent"),
        parse_iso(get("reviewed_at")).alias("reviewed_at"),
        get("deskew_angle", "double").alias("deskew_angle"),
    )


def native_text_boxes(pages: DataFrame) -> DataFrame:
    """Pages with native text as one result with one full-page box; blank pages give none.

    ``pages(page_id, text, width, height)``.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    return pages.where(text != "").select(
        "page_id",
        F.lit("pdf_native").alias("source"),
        F.lit(0).cast("long").alias("box_index"),
        text.alias("text"),
        F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)]).alias("bbox"),
        *[F.lit(0).cast("long").alias(c) for c in ("x1", "y1")],
        F.col("width").cast("long").alias("x2"),
        F.col("height").cast("long").alias("y2"),
    )
