"""Operators on documents, pages and multi-page content units.

Units come as ``units(unit_id, document_id, is_public, year, title, summary,
topic, place, ...)`` and ``unit_pages(unit_id, pos, page_id)``; people of a
unit as ``persons(unit_id, pos, name, role)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T
from pagegrain.operators import spread

# First and last year of the two epochs of the collection.
EPOCHS = {"30er": (1927, 1937), "90er": (1990, 2008)}


def epoch(year: Column) -> Column:
    """name of the epoch a year falls into, else null."""
    out = None
    for name, (low, high) in EPOCHS.items():
        hit = year.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# --- building units ---------------------------------------------------------------


def pair_pages(pages: DataFrame, key: str = "document_id", pos: str = "page_number") -> DataFrame:
    """Join a page that belongs with the next one to its successor, pairs at most.

    ``pages(key, pos, page_id, belongs_with_next)``.  Reading from the front, a
    page that is not yet taken starts a unit and takes its successor if it says
    so.  In a run of consecutive yes-pages the first starts, the second is
    taken, the third starts, and so on: a page starts a unit exactly when the
    run of yes-pages just before it has even length.
    """
    ranked = spread.row_numbers(pages, [key], [F.col(pos)], "_p")
    no = F.when(~F.coalesce("belongs_with_next", F.lit(False)), F.col("_p"))
    marked = spread.running(ranked, [key], "_p", no, "_no", "max")
    starts = (F.col("_p") - 1 - F.coalesce("_no", F.lit(0))) % 2 == 0
    placed = marked.select(
        key, "page_id", F.when(starts, F.col("_p")).otherwise(F.col("_p") - 1).alias("unit_start"), "_p"
    )
    second = F.when(F.col("_p") > F.col("unit_start"), F.col("page_id"))
    first = F.when(F.col("_p") == F.col("unit_start"), F.col("page_id"))
    return placed.groupBy(key, "unit_start").agg(
        F.max(first).alias("first_page"), F.max(second).alias("second_page"), F.count(F.lit(1)).alias("pages")
    )


def accept_suggestions(
    units: DataFrame, suggestions: DataFrame, document_id: int, first_id: Column | int
) -> tuple[DataFrame, DataFrame]:
    """The suggestions of a document become units, in id order, and vanish."""
    mine = suggestions.where(F.col("document_id") == document_id)
    made = spread.row_numbers(mine, [], [F.col("id")], "_k").select(
        (F.col("_k") - 1 + (F.lit(first_id) if isinstance(first_id, int) else first_id)).alias("unit_id"),
        "document_id",
        "page_ids",
        "belongs_with_next",
    )
    return units.unionByName(made, allowMissingColumns=True), suggestions.where(
        F.col("document_id") != document_id
    )


def fill_units(units: DataFrame, contents: DataFrame) -> DataFrame:
    """Units without a summary take the parsed content fields."""
    fields = ("summary", "topic", "place", "event_date")
    c = contents.select("unit_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    open_unit = F.col("summary").isNull() & F.coalesce("_hit", F.lit(False))
    joined = units.join(c, "unit_id", "left")
    out = {f: F.when(open_unit, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(out).drop("_hit", *[f"_{f}" for f in fields])


def merged_entries(units: DataFrame, settings: DataFrame) -> DataFrame:
    """Distinct phrases and names of each document's units and of the settings.

    ``units(document_id, extracted_phrases, extracted_names)``;
    ``settings(document_id, typical_phrases, expected_names)`` holds texts whose
    entries are separated by newlines and commas.  One row per entry.
    """

    def given(column: str, kind: str) -> DataFrame:
        return units.select("document_id", F.lit(kind).alias("kind"), F.explode(column).alias("entry"))

    def stored(column: str, kind: str) -> DataFrame:
        parts = F.split(F.coalesce(F.col(column), F.lit("")), "[,\n]")
        return settings.select("document_id", F.lit(kind).alias("kind"), F.explode(parts).alias("entry"))

    rows = (
        given("extracted_phrases", "phrase")
        .unionByName(given("extracted_names", "name"))
        .unionByName(stored("typical_phrases", "phrase"))
        .unionByName(stored("expected_names", "name"))
    )
    return (
        rows.withColumn("entry", T.strip("entry")).where(F.col("entry") != "").distinct()
    )


def merge_phrases_names(units: DataFrame, settings: DataFrame) -> DataFrame:
    """A15 as the two settings texts of each document: sorted, newline and comma joined."""
    entries = merged_entries(units, settings)

    def joined(kind: str, sep: str, name: str) -> DataFrame:
        return spread.ordered_concat(
            entries.where(F.col("kind") == kind), ["document_id"], ["entry"], F.substring("entry", 1, 2), "entry", sep, name
        )

    return joined("phrase", "\n", "typical_phrases").join(
        joined("name", ", ", "expected_names"), "document_id", "full"
    )


# --- pages and units ---------------------------------------------------------------


def unassigned_pages(pages: DataFrame, unit_pages: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Pages in no unit, by document and page number, with their text."""
    return (
        pages.join(unit_pages.select("page_id"), "page_id", "left_anti")
        .join(page_texts, "page_id", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .orderBy("document_id", "page_number")
    )


def composed_units(units: DataFrame, unit_pages: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Units with their page numbers in unit order (unknown pages count 0) and full text."""
    numbered = unit_pages.join(pages.select("page_id", "page_number"), "page_id", "left").withColumn(
        "_n", F.coalesce(F.col("page_number"), F.lit(0)).cast("string")
    )
    numbers = spread.ordered_concat(
        numbered, ["unit_id"], ["pos"], spread.int_bucket("pos", 256), "_n", ",", "page_numbers"
    )
    return units.join(numbers, "unit_id", "left").join(texts, "unit_id", "left")


def foreign_pages(units: DataFrame, unit_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of a unit that do not belong to its document."""
    own = pages.select("page_id", "document_id")
    return (
        unit_pages.join(units.select("unit_id", "document_id"), "unit_id")
        .join(own, ["page_id", "document_id"], "left_anti")
        .select("unit_id", "page_id")
    )


def scan_inventory(units: DataFrame, unit_pages: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """State of every page of every public unit: extracted, to_extract or error."""
    public = units.where("is_public").select("unit_id", "document_id")
    d = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("_doc"))
    p = pages.select(
        "page_id",
        F.lit(True).alias("_page"),
        (F.col("file_path").isNotNull() & F.coalesce("is_extracted", F.lit(False))).alias("_done"),
    )
    state = (
        F.when(F.col("_doc").isNull() | F.col("_page").isNull(), "error")
        .when(F.col("_done"), "extracted")
        .otherwise("to_extract")
    )
    return (
        unit_pages.join(public, "unit_id")
        .join(d, "document_id", "left")
        .join(p, "page_id", "left")
        .select("unit_id", "pos", "page_id", state.alias("state"))
    )


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("state").agg(F.count(F.lit(1)).alias("pages"))


def public_page_list(unit_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of a unit in unit order with the address of their scan; unknown ids are skipped."""
    shown = F.col("file_path").isNotNull() & F.coalesce("is_extracted", F.lit(False))
    url = F.format_string("/scans/%d/%d.png", "document_id", "page_number")
    return unit_pages.join(pages, "page_id").select(
        "unit_id", "pos", "page_id", "page_number", F.when(shown, url).alias("image_url")
    )


def public_units(units: DataFrame, document_type: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Public units, newest date first, undated last."""
    u = units.where("is_public")
    if document_type is not None:
        u = u.where(F.col("document_type") == document_type)
    return u.orderBy(F.desc_nulls_last("year"), "unit_id").offset(offset).limit(limit)


def public_documents(units: DataFrame, epoch_name: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """T4: public units by date with their epoch; the epoch filter comes before paging."""
    u = units.where("is_public").withColumn("epoch", epoch(F.col("year")))
    if epoch_name is not None:
        u = u.where(F.col("epoch") == epoch_name)
    return u.orderBy(F.desc_nulls_last("year"), "unit_id").offset(offset).limit(limit)


def featured_unit(units: DataFrame, persons: DataFrame) -> DataFrame:
    """T5: the newest public unit with a summary, else the newest by id; with its first person's slug."""
    has = F.coalesce(F.col("summary") != "", F.lit(False))
    one = (
        units.where("is_public")
        .withColumn("_has", has)
        .orderBy(F.desc("_has"), F.desc_nulls_last(F.when(has, F.col("year"))), F.desc("unit_id"))
        .limit(1)
        .drop("_has")
    )
    named = persons.where(F.coalesce(F.col("name"), F.lit("")) != "").join(one.select("unit_id"), "unit_id", "left_semi")
    first = named.groupBy("unit_id").agg(F.min_by("name", "pos").alias("_name"))
    return one.join(first, "unit_id", "left").withColumn("person_slug", T.slug("_name")).drop("_name")


def list_documents(documents: DataFrame, status: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """P10: documents by id, optionally of one status."""
    d = documents if status is None else documents.where(F.col("status") == status)
    return d.orderBy("id").offset(offset).limit(limit)


def children_of_document(rows: DataFrame, document_id: int, order: str) -> DataFrame:
    """Child rows of a document: pages by page number, units and suggestions by id."""
    return rows.where(F.col("document_id") == document_id).orderBy(order)


def merge_pages(pages: DataFrame, chosen: DataFrame, parent_id: int, filename: str, title: str | None = None) -> DataFrame:
    """A composite document and one child document per chosen page, numbered in page order.

    When a chosen page is missing the result has one row with the error.
    """
    ids = chosen.select("page_id").distinct()
    found = pages.join(ids, "page_id", "left_semi")
    lost = ids.join(pages.select("page_id"), "page_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    numbered = spread.row_numbers(found, [], [F.col("page_number"), F.col("page_id")], "child_number")
    children = numbered.where(lost == 0).select(
        F.lit(parent_id).cast("long").alias("parent_document_id"),
        F.lit(0).alias("is_composite"),
        F.col("child_number").alias("page_number"),
        F.format_string(f"{filename}_Seite_%d", "child_number").alias("filename"),
        "page_id",
        F.lit(None).cast("string").alias("error"),
    )
    parent = ids.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(None).cast("long").alias("parent_document_id"),
        F.lit(1).alias("is_composite"),
        F.lit(None).cast("long").alias("page_number"),
        F.lit(title or filename).alias("filename"),
        F.lit(None).cast("long").alias("page_id"),
        F.when(lost > 0, "not all pages found").alias("error"),
    )
    return parent.unionByName(children)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table when documents (``gone.document_id``) are deleted.

    ``tables`` may hold documents, document_metadata, pages, results, boxes,
    jobs, units and mention_boxes; boxes hang on results, mentions on pages.
    """
    ids = gone.select("document_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "documents":
            out[name] = df.join(ids.withColumnRenamed("document_id", "id"), "id", "left_anti")
        elif name == "boxes":
            dead = tables["results"].join(ids, "document_id", "left_semi").select(F.col("id").alias("result_id"))
            out[name] = df.join(dead, "result_id", "left_anti")
        elif name == "mention_boxes":
            dead = tables["pages"].join(ids, "document_id", "left_semi").select(F.col("id").alias("page_id"))
            out[name] = df.join(dead, "page_id", "left_anti")
        else:
            out[name] = df.join(ids, "document_id", "left_anti")
    return out


# --- notes and stories ---------------------------------------------------------------


def list_notes(
    notes: DataFrame,
    pages: DataFrame,
    search: str | None = None,
    document_id: int | None = None,
    unassigned: bool | None = None,
    limit: int = 200,
) -> DataFrame:
    """Note boxes with page and document, by id; filters on text, document, assignment."""
    n = notes.where(F.col("box_type") == "note").join(pages, "page_id")
    if (search or "").strip():
        n = n.where(F.contains(F.lower("note_text"), F.lit(search.strip().lower())))
    if document_id is not None:
        n = n.where(F.col("document_id") == document_id)
    if unassigned is not None:
        n = n.where(F.col("story_id").isNull() if unassigned else F.col("story_id").isNotNull())
    return n.orderBy("id").limit(limit)


def story_sources(
    stories: DataFrame, notes: DataFrame, results: DataFrame, pages: DataFrame, units: DataFrame
) -> DataFrame:
    """Notes (with text) of published stories with page and first unit of the document."""
    first_unit = units.groupBy("document_id").agg(F.min("unit_id").alias("unit_id"))
    r = results.select(F.col("id").alias("result_id"), "page_id")
    p = pages.select("page_id", "document_id", "page_number")
    return (
        stories.where("is_published")
        .select("story_id", "slug")
        .join(notes.where(F.coalesce("note_text", F.lit("")) != ""), "story_id")
        .join(r, "result_id", "left")
        .join(p, "page_id", "left")
        .join(first_unit, "document_id", "left")
        .select("slug", "story_id", "note_id", "note_text", "document_id", "page_number", "unit_id")
    )


def stories(
    rows: DataFrame, featured: bool | None = None, epoch_name: str | None = None, published: bool = True, limit: int | None = None
) -> DataFrame:
    """Stories, last updated first; published, featured or of an epoch only."""
    if published:
        rows = rows.where("is_published")
    if featured is not None:
        rows = rows.where(F.col("is_featured") == featured)
    if epoch_name is not None:
        rows = rows.where(F.col("epoch") == epoch_name)
    rows = rows.orderBy(F.desc("updated_at"), F.desc("story_id"))
    return rows if limit is None else rows.limit(limit)


def assign_notes(notes: DataFrame, story_id: int, ids: DataFrame) -> DataFrame:
    """A story's notes become exactly the given ids; no id at all changes nothing."""
    given = ids.select("note_id").distinct()
    any_id = given.agg(F.count(F.lit(1))).scalar() > 0
    n = notes.join(given.withColumn("_hit", F.lit(True)), "note_id", "left")
    is_note = F.col("box_type") == "note"
    return n.withColumn(
        "story_id",
        F.when(is_note & F.col("_hit"), F.lit(story_id).cast("long"))
        .when(is_note & any_id & (F.col("story_id") == story_id), F.lit(None))
        .otherwise(F.col("story_id")),
    ).drop("_hit")
