"""Operators on mention boxes: people, their events and co-mentions.

``mentions(id, page_id, source_box, entity_uri, event_type, start_date,
end_date)``.  Lists per person come as rows with a position instead of arrays,
so a person with very many mentions stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T
from pagegrain.operators import spread

# Order of event types on the time line, and those with a duration.
EVENT_RANK = {"president": 1, "board": 2, "membership": 3, "vortrag": 4, "diskussion": 5, "gast": 6}
RANGE_TYPES = ("president", "board", "membership")
TERM_TYPES = ("president", "board")
NO_RANK = 999


def _people(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.contains(F.coalesce("entity_uri", F.lit("")), F.lit("Person_")))


def pages_with_mentions(mentions: DataFrame) -> DataFrame:
    """Pages with at least one mention box, and how many."""
    return mentions.groupBy("page_id").agg(F.count(F.lit(1)).alias("box_count"))


def entity_catalogue(mentions: DataFrame, details: DataFrame) -> DataFrame:
    """People with name, image, local id and their distinct pages in first-seen order.

    ``details(entity_uri, name, main_image_url)``; ``mentions.name`` is the
    fallback name.  One row per person and page.
    """
    m = _people(mentions)
    seen = m.groupBy("entity_uri", "page_id").agg(
        F.min("id").alias("_first"), F.min_by("name", "id").alias("_box_name")
    )
    pos = spread.row_numbers(seen, ["entity_uri"], [F.col("_first")], "pos")
    first_name = seen.groupBy("entity_uri").agg(F.min_by("_box_name", "_first").alias("_name"))
    d = details.select("entity_uri", F.col("name").alias("_stored"), "main_image_url")
    return (
        pos.join(first_name.join(d, "entity_uri", "left"), "entity_uri")
        .select(
            "entity_uri",
            T.local_id("entity_uri").alias("entity_id"),
            F.coalesce(F.nullif(F.col("_stored"), F.lit("")), F.col("_name")).alias("name"),
            "main_image_url",
            "page_id",
            "pos",
        )
    )


def filter_events(
    events: DataFrame, from_year: int | None = None, to_year: int | None = None, types: list[str] | None = None
) -> DataFrame:
    """Events whose known dates lie within the years; undated ones only without a bound."""
    e = events.where(F.col("event_type").isNotNull())
    if from_year is not None or to_year is not None:
        for c in ("start_date", "end_date"):
            y = F.year(c)
            ok = F.lit(True)
            if from_year is not None:
                ok = ok & (y >= from_year)
            if to_year is not None:
                ok = ok & (y <= to_year)
            e = e.where(F.col(c).isNull() | ok)
        e = e.where(F.col("start_date").isNotNull() | F.col("end_date").isNotNull())
    return e.where(F.col("event_type").isin(types)) if types else e


def event_rank() -> Column:
    out = None
    for name, rank in EVENT_RANK.items():
        hit = F.col("event_type") == name
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out.otherwise(NO_RANK)


def person_timeline(events: DataFrame, details: DataFrame) -> DataFrame:
    """Events per person as ranges and points, people ordered by best rank and name.

    A range without an end ends where it starts.
    """
    e = _people(events)
    best = e.groupBy("entity_uri").agg(F.min(event_rank()).alias("sort_rank"))
    d = details.select("entity_uri", F.coalesce("name", F.lit("")).alias("person_name"))
    is_range = F.col("event_type").isin(*RANGE_TYPES)
    return (
        e.join(best.join(d, "entity_uri", "left"), "entity_uri")
        .select(
            "entity_uri",
            T.local_id("entity_uri").alias("entity_id"),
            F.coalesce("person_name", F.lit("")).alias("person_name"),
            "sort_rank",
            F.when(is_range, "range").otherwise("point").alias("kind"),
            F.col("event_type").alias("type"),
            "id",
            "page_id",
            F.col("start_date").alias("start"),
            F.coalesce(F.col("end_date"), F.when(is_range, F.col("start_date"))).alias("end"),
        )
        .orderBy("sort_rank", "person_name", "entity_uri", "id")
    )


def co_mentions(mentions: DataFrame, anchors: DataFrame, grain: str = "source_box") -> DataFrame:
    """People mentioned together with the anchor people, and in how many places.

    Starts from ``anchors(entity_uri)``, as the network view of one person
    does: the anchors' places are found first, then the others at those
    places, so work grows with the mentions and not with all pairs.
    ``grain`` is the source box or the page's document.
    """
    at = _people(mentions).select(grain, "entity_uri").distinct()
    here = at.join(anchors.select("entity_uri").distinct(), "entity_uri", "left_semi").select(
        grain, F.col("entity_uri").alias("anchor_uri")
    )
    return (
        at.join(here, grain)
        .where(F.col("entity_uri") != F.col("anchor_uri"))
        .groupBy("anchor_uri", "entity_uri")
        .agg(F.count(F.lit(1)).alias("places"))
    )


def co_mention_classes(mentions: DataFrame, grain: str = "source_box") -> DataFrame:
    """J13 over all people, factored: places with the same people form a class.

    One row per person and class: ``class_id`` (its least place), ``places``, ``people`` and ``entity_uri``. Two people
    are mentioned together in as many places as their common classes have, so the pairs are exact without being
    written, and the result grows with the mentions. Equal sets are known by their size and two 64-bit hashes.
    Mentions without a place and places with one person give no row.
    """
    at = _people(mentions).where(F.col(grain).isNotNull()).select(grain, "entity_uri").distinct()
    sets = at.groupBy(grain).agg(
        F.count(F.lit(1)).alias("people"),
        *[F.bit_xor(F.xxhash64(F.lit(seed), "entity_uri")).alias(f"_h{seed}") for seed in (1, 2)],
    )
    classes = sets.where(F.col("people") > 1).groupBy("people", "_h1", "_h2").agg(
        F.min(grain).alias("class_id"), F.count(F.lit(1)).alias("places")
    )
    members = at.select(F.col(grain).alias("class_id"), "entity_uri")
    return classes.join(members, "class_id").select("class_id", "places", "people", "entity_uri")


def mention_list(mentions: DataFrame, pages: DataFrame, documents: DataFrame, details: DataFrame) -> DataFrame:
    """Mention boxes with document title and the entity's main image."""
    p = pages.select("page_id", "document_id", "page_number")
    d = documents.select(F.col("id").alias("document_id"), F.coalesce("title", "filename").alias("document_title"))
    img = details.select("entity_uri", "main_image_url")
    return mentions.join(p, "page_id").join(d, "document_id").join(img, "entity_uri", "left")


def default_terms(events: DataFrame, current_year: int) -> DataFrame:
    """fill the dates of an event.

    Board and president terms start on 1 July of the current year and end on
    30 June of the year after they start; talks, discussions and guests start
    on the date of their page (``page_date``).
    """
    term = F.col("event_type").isin(*TERM_TYPES)
    point = F.col("event_type").isin("vortrag", "diskussion", "gast")
    start = F.coalesce(
        F.col("start_date"),
        F.when(term, F.make_timestamp(*[F.lit(v) for v in (current_year, 7, 1, 0, 0, 0)])),
        F.when(point, F.col("page_date")),
    )
    e = events.withColumn("start_date", start)
    end = F.make_timestamp(F.year("start_date") + 1, *[F.lit(v) for v in (6, 30, 0, 0, 0)])
    return e.withColumn("end_date", F.coalesce(F.col("end_date"), F.when(term, end)))


def membership_events(entity_boxes: DataFrame, target_uri: str, current_year: int) -> DataFrame:
    """Source boxes for membership events of linked people, with default dates."""
    linked = entity_boxes.where(F.coalesce("entity_uri", F.lit("")) != "")
    return default_terms(linked, current_year).select(
        "id",
        "page_id",
        F.lit("beleg").alias("box_type"),
        F.concat(F.col("event_type"), F.lit(f": {target_uri}")).alias("name"),
        F.col("entity_uri").alias("subject_uri"),
        F.lit("wirdTeilVon").alias("predicate_uri"),
        F.lit(target_uri).alias("object_uri"),
        "event_type",
        "start_date",
        "end_date",
    )
