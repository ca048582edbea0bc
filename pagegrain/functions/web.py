"""Column functions and small operators on web pages and media references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import text as T

# How an image address is told, and the sizes kept of an image.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif")
IMAGE_PARTS = ("/iiif/", "/image/", "special:filepath")
IMAGE_SIZES = (64, 128, 256, 512)

# Patterns of a preview image tag and of an anchor.
OG_IMAGE = r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']"""
ANCHOR = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def strip_html(c: Column | str) -> Column:
    """tags become blanks, whitespace is collapsed and trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return T.strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), f"[{T.SPACES}]+", " "))


def og_image(html: Column | str) -> Column:
    """content of the og:image meta tag (property before content), else null."""
    html = F.col(html) if isinstance(html, str) else html
    return F.nullif(T.strip(F.regexp_extract(html, OG_IMAGE, 1)), F.lit(""))


def html_links(
    pages: DataFrame,
    keys: Sequence[str],
    html: str,
    site: str,
    must_contain: Sequence[str] = (),
    deny: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """anchors of a page as (pos, href, title).

    Root-relative addresses are put under ``site``; links without text, with a
    denied part or (when given) without an allowed part are dropped; of equal
    addresses (case aside) the first stays; at most ``limit`` per page.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("inner"),
    )
    raw = pages.select(*keys, F.posexplode(pairs).alias("pos", "_a")).select(
        *keys, "pos", T.strip("_a.href").alias("href"), strip_html(F.col("_a.inner")).alias("title")
    )
    absolute = F.when(F.col("href").startswith("/") & ~F.col("href").startswith("//"), F.concat(F.lit(site), F.col("href"))).otherwise(F.col("href"))
    links = raw.withColumn("href", absolute).where(F.col("title") != "")
    for part in deny:
        links = links.where(~F.contains("href", F.lit(part)))
    if must_contain:
        any_part = F.lit(False)
        for part in must_contain:
            any_part = any_part | F.contains("href", F.lit(part))
        links = links.where(any_part)
    first = links.groupBy(*keys, F.lower("href").alias("_k")).agg(
        F.min(F.struct("pos", "href", "title")).alias("_f")
    ).select(*keys, "_f.*")
    if limit is None:
        return first
    w = Window.partitionBy(*keys).orderBy("pos")
    return first.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def image_urls_in_json(df: DataFrame, keys: Sequence[str], json: str) -> DataFrame:
    """F8: every string value in a nested JSON text that is the address of an image."""
    # escaped backslashes and quotes stand aside as control characters, which JSON never holds as such: the pattern
    # then needs no alternatives, whose matching would recurse over long strings
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    # keys are matched too, so that quotes pair up, and then dropped by their colon
    pattern = F.lit(r'"([^"]*+)"(\s*+:)?')
    strings = F.arrays_zip(
        F.regexp_extract_all(plain, pattern, F.lit(1)).alias("s"),
        F.regexp_extract_all(plain, pattern, F.lit(2)).alias("colon"),
    )
    values = df.select(*keys, F.explode(strings).alias("_x")).where(F.col("_x.colon") == "")
    text = F.replace(F.replace("_x.s", F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    urls = values.select(*keys, T.strip(F.replace(text, F.lit("\\/"), F.lit("/"))).alias("url"))
    low = F.lower("url")
    image = F.lit(False)
    for e in IMAGE_ENDINGS:
        image = image | low.endswith(e)
    for p in IMAGE_PARTS:
        image = image | F.contains(low, F.lit(p))
    return urls.where(low.startswith("http") & image)


def cache_key(source_key: Column) -> Column:
    """key of a cached image."""
    return F.sha2(source_key, 256)


def cached_images(sources: DataFrame) -> DataFrame:
    """one row per source key, the first (least ``id``) of each."""
    return (
        sources.groupBy("source_key")
        .agg(F.min(F.struct("id", "source_url")).alias("_f"))
        .select(cache_key(F.col("source_key")).alias("cache_key"), "source_key", "_f.id", "_f.source_url")
    )


def variant_sizes(c: Column) -> Column:
    """positive sizes of a comma list, sorted and unique; none gives the default sizes."""
    parsed = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: T.strip(x).try_cast("int"))
    good = F.array_sort(F.array_distinct(F.filter(parsed, lambda x: x > 0)))
    return F.when(F.size(good) > 0, good).otherwise(F.array(*[F.lit(s) for s in IMAGE_SIZES]))
