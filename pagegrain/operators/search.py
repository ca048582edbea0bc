"""Full-text search over public units and the people in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T
from pagegrain.operators import spread
from pagegrain.operators.boxes import unit_text
from pagegrain.operators.units import epoch


def _has(text: Column, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(term))


def _visible(units: DataFrame, epoch_name: str | None) -> DataFrame:
    u = units.where("is_public").withColumn("epoch", epoch(F.col("year")))
    return u if epoch_name is None else u.where(F.col("epoch") == epoch_name)


def search_documents(
    units: DataFrame, unit_pages: DataFrame, results: DataFrame, page_texts: DataFrame, term: str, epoch_name: str | None = None
) -> DataFrame:
    """X2, units: hits in title, summary, topic, place, else in a recognised page text.

    ``results(page_id, text)``.  The snippet is the matching field (for the
    title the summary), or 60 characters around the hit in the unit text.
    """
    term = term.strip().lower()
    fields = ("title", "summary", "topic", "place")
    by_field = None
    shown = None
    for f in fields:
        hit = _has(F.col(f), term)
        value = F.lit(None).cast("string") if f == "title" else F.col(f)
        by_field = hit if by_field is None else by_field | hit
        shown = F.when(hit, value) if shown is None else shown.when(hit, value)
    u = _visible(units, epoch_name).withColumns({"_field": by_field, "_shown": shown})
    hit_pages = results.where(_has(F.col("text"), term)).select("page_id")
    rest = u.where(~F.col("_field"))
    in_text = rest.join(
        unit_pages.join(hit_pages, "page_id", "left_semi").select("unit_id"), "unit_id", "left_semi"
    )
    texts = unit_text(unit_pages.join(in_text.select("unit_id"), "unit_id", "left_semi"), page_texts)
    at = T.hit_position("text", F.lit(term))
    cut = F.when(at > 0, T.cut_around("text", at, F.lit(len(term)), 60))
    found = in_text.join(texts, "unit_id", "left").withColumn("_shown", cut)
    out = [
        F.lit("document").alias("type"),
        "unit_id",
        F.col("unit_id").cast("string").alias("slug"),
        F.coalesce(
            F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Dokument #"), F.col("document_id").cast("string"))
        ).alias("display_name"),
        "epoch",
        F.coalesce(F.nullif(F.col("_shown"), F.lit("")), F.col("summary")).alias("snippet"),
    ]
    return u.where("_field").select(*out).unionByName(found.select(*out))


def search_people(units: DataFrame, persons: DataFrame, term: str, epoch_name: str | None = None) -> DataFrame:
    """X2, people: name contains the term, or the unit's summary does; each slug once.

    The first occurrence (by unit, then position) gives name, role and epoch;
    ``id`` numbers the people in that order.
    """
    term = term.strip().lower()
    u = _visible(units, epoch_name).select("unit_id", "epoch", "summary")
    p = persons.where(F.coalesce("name", F.lit("")) != "").join(u, "unit_id")
    p = p.where(_has(F.col("name"), term) | _has(F.col("summary"), term)).withColumn("slug", T.slug("name"))
    first = p.groupBy("slug").agg(
        F.min(F.struct("unit_id", "pos", "name", "role", "epoch")).alias("_f")
    ).select("slug", "_f.*")
    numbered = spread.row_numbers(first, [], [F.col("unit_id"), F.col("pos"), F.col("slug")], "id")
    return numbered.select(
        F.lit("person").alias("type"), "id", "slug", F.col("name").alias("display_name"), "epoch", F.col("role").alias("snippet")
    )


def person_directory(units: DataFrame, persons: DataFrame, epoch_name: str | None = None, q: str | None = None) -> DataFrame:
    """People of public units by exact name, numbered by first appearance.

    Role of the first appearance; the epoch is the first known one.
    """
    u = _visible(units, epoch_name).select("unit_id", "epoch")
    p = persons.where(F.coalesce("name", F.lit("")) != "").join(u, "unit_id")
    if q:
        p = p.where(_has(F.col("name"), q.lower()))
    people = p.groupBy("name").agg(
        F.min(F.struct("unit_id", "pos", "role")).alias("_f"),
        F.min_by("epoch", F.when(F.col("epoch").isNotNull(), F.struct("unit_id", "pos"))).alias("epoch"),
    ).select("name", "epoch", "_f.*")
    return spread.row_numbers(people, [], [F.col("unit_id"), F.col("pos"), F.col("name")], "id").select("id", T.slug("name").alias("slug"), F.col("name").alias("display_name"), "epoch", F.col("role").alias("notes"))


def person_detail(
    units: DataFrame, persons: DataFrame, unit_pages: DataFrame, page_texts: DataFrame, slug: str
) -> DataFrame:
    """One row per mention of a person (by slug or exact name) in a dated or summarised public unit.

    Name, epoch and role come from the first mention of all; the snippet is cut
    around that name in the unit text.
    """
    mine = persons.where((F.coalesce("name", F.lit("")) != "") & ((T.slug("name") == slug) | (F.col("name") == slug)))
    hits = mine.join(units.where("is_public"), "unit_id").withColumn("slug", F.lit(slug))
    head = hits.groupBy("slug").agg(  # one row at most
        F.min_by(F.struct("name", "role", epoch(F.col("year")).alias("epoch")), F.struct("unit_id", "pos")).alias("_h")
    )
    texts = unit_text(unit_pages.join(hits.select("unit_id"), "unit_id", "left_semi"), page_texts)
    dated = F.col("year").isNotNull() | (F.coalesce("summary", F.lit("")) != "")
    return hits.where(dated).join(texts, "unit_id", "left").join(F.broadcast(head), "slug").select(
        "slug",
        F.col("_h.name").alias("display_name"),
        "_h.role",
        "_h.epoch",
        "unit_id",
        "pos",
        "year",
        T.snippet("text", F.col("_h.name"), "summary", 120).alias("snippet"),
    )


def unit_detail(units: DataFrame, unit_pages: DataFrame, page_texts: DataFrame, persons: DataFrame) -> DataFrame:
    """Public units with epoch, text and the numbers of their pages and people."""
    texts = unit_text(unit_pages, page_texts)
    pages = unit_pages.groupBy("unit_id").agg(F.count(F.lit(1)).alias("page_count"))
    people = persons.groupBy("unit_id").agg(F.count(F.lit(1)).alias("person_count"))
    return (
        units.where("is_public")
        .withColumn("epoch", epoch(F.col("year")))
        .join(texts, "unit_id", "left")
        .join(pages, "unit_id", "left")
        .join(people, "unit_id", "left")
    )
