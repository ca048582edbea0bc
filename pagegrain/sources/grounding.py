"""Reading the answers of a vision model that marks texts with boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T

# One marked text, its pixel corners and the text that follows.
PATTERN = (
    r"<\|ref\|>([^<]*)<\|/ref\|><\|det\|>\[\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]\]<\|/det\|>\s*\n?([^\n<]*)"
)


def parse_grounding(answers: DataFrame, key: str = "page_id", answer: str = "answer") -> DataFrame:
    """Box rows of each answer; needs ``width`` and ``height`` of the image.

    All-zero boxes are dropped; a height (width) of zero at the upper (left)
    border becomes the whole height (width); other empty boxes are dropped.
    The text after the mark wins over the marked text.
    """
    groups = [F.regexp_extract_all(answer, F.lit(PATTERN), F.lit(i)).alias(f"g{i}") for i in range(1, 7)]
    found = answers.select(key, "width", "height", F.posexplode(F.arrays_zip(*groups)).alias("det_index", "_g"))
    n = [F.col(f"_g.g{i}").cast("long") for i in range(2, 6)]
    ref, after = T.strip("_g.g1"), T.strip("_g.g6")
    boxes = found.select(
        key,
        F.col("det_index").cast("long").alias("det_index"),
        "width",
        "height",
        F.when(after != "", after).otherwise(ref).alias("text"),
        *[c.alias(name) for c, name in zip(n, ("x1", "y1", "_x2", "_y2"), strict=True)],
    )
    boxes = boxes.where((F.col("x1") + F.col("y1") + F.col("_x2") + F.col("_y2")) > 0)
    flat = (F.col("y1") == 0) & (F.col("_y2") == 0)
    thin = (F.col("x1") == 0) & (F.col("_x2") == 0)
    boxes = boxes.withColumns(
        {
            "y2": F.when(flat & (F.col("height") > 0), F.col("height")).otherwise(F.col("_y2")),
            "x2": F.when(thin & (F.col("width") > 0), F.col("width")).otherwise(F.col("_x2")),
        }
    ).where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    return boxes.select(
        key,
        "det_index",
        "text",
        "x1",
        "y1",
        "x2",
        "y2",
        *[
            F.when(sized, F.col(c) / F.col(s)).otherwise(F.col(c).cast("double")).alias(f"rel_{c}")
            for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))
        ],
    )
