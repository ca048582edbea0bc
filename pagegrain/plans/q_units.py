"""Queries on documents, units, search and people of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T
from pagegrain.operators import boxes as B
from pagegrain.operators import search as X
from pagegrain.operators import units as U
from pagegrain.plans import sqlbits as S
from pagegrain.plans.q_boxes import DOCUMENTS, UNIT_PAGES, UNIT_TEXT, documents_of, unit_pages
from pagegrain.plans.registry import query

# --- bindings: one unit per conversation, its turns are its pages -----------------

UNITS = """
SELECT unit_id, unit_id % 10 AS document_id, any_value(is_public) AS is_public, any_value(year) AS year, concat('Akte ', unit_id) AS title,
  CASE WHEN unit_id % 4 <> 0 THEN max(CASE WHEN pos = 0 THEN text END) END AS summary,
  CASE WHEN unit_id % 5 = 1 THEN 'Musik' END AS topic, CASE WHEN unit_id % 6 = 2 THEN 'Dresden' END AS place
FROM a_unit_page GROUP BY unit_id
"""
EPOCH = "CASE WHEN year BETWEEN 1927 AND 1937 THEN '30er' WHEN year BETWEEN 1990 AND 2008 THEN '90er' END"
SLUG = f"trim(regexp_replace(regexp_replace({S.strip('lower(name)')}, '[^a-z0-9{S.WS}-]', '', 'g'), '[{S.WS}-]+', '-', 'g'), '-')"
PERSONS = "SELECT unit_id, pos, person_name AS name, role FROM a_unit_page"


def units(b):
    u = F.col("unit_id")
    return b.a_unit_page.groupBy("unit_id").agg(
        F.max("is_public").alias("is_public"),
        F.max("year").alias("year"),
        F.max(F.when(F.col("pos") == 0, F.col("text"))).alias("_first"),
    ).select(
        "unit_id",
        (u % 10).alias("document_id"),
        "is_public",
        "year",
        F.concat(F.lit("Akte "), u.cast("string")).alias("title"),
        F.when(u % 4 != 0, F.col("_first")).alias("summary"),
        F.when(u % 5 == 1, "Musik").alias("topic"),
        F.when(u % 6 == 2, "Dresden").alias("place"),
    )


def persons(b):
    return b.a_unit_page.select("unit_id", "pos", F.col("person_name").alias("name"), "role")


def turns(b):
    return b.a_unit_page.select("unit_id", "pos", "page_id")


def turn_texts(b):
    return b.a_unit_page.select("page_id", "text")


@query(
    "w4_pair_pages",
    """WITH r AS (SELECT *, page_id % 5 <> 3 AND belongs_with_next AS yes, row_number() OVER (PARTITION BY unit_id ORDER BY pos) AS p FROM a_unit_page),
    f AS (SELECT *, max(CASE WHEN NOT yes THEN p END) OVER (PARTITION BY unit_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS no FROM r),
    s AS (SELECT *, CASE WHEN (p - 1 - coalesce(no, 0)) % 2 = 0 THEN p ELSE p - 1 END AS unit_start FROM f)
    SELECT unit_id, unit_start, max(CASE WHEN p = unit_start THEN page_id END) AS first_page, max(CASE WHEN p > unit_start THEN page_id END) AS second_page, count(*) AS pages FROM s GROUP BY unit_id, unit_start""",
)
def _(b):
    # some pages have no flag
    flag = F.when(F.col("page_id") % 5 != 3, F.col("belongs_with_next"))
    return U.pair_pages(b.a_unit_page.withColumn("belongs_with_next", flag), "unit_id", "pos")


def pages(b):
    """Box pages with a scan file for every page whose id is not a multiple of 7."""
    return b.a_page.select(
        F.col("id").alias("page_id"),
        "document_id",
        "page_number",
        "is_extracted",
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("file_path"),
    )


PAGES = "SELECT id AS page_id, document_id, page_number, is_extracted, CASE WHEN id % 7 <> 0 THEN concat('p', id) END AS file_path FROM a_page"


def shifted_units(b):
    """Units of four pages; the ids run three beyond the pages that exist."""
    u = unit_pages(b).withColumn("page_id", F.col("page_id") + 3)
    heads = u.select("unit_id").distinct().select(
        "unit_id", (F.col("unit_id") % 23).alias("document_id"), (F.col("unit_id") % 3 != 0).alias("is_public")
    )
    return heads, u


_SHIFTED = f"SELECT unit_id, pos, page_id + 3 AS page_id, unit_id % 23 AS document_id, unit_id % 3 <> 0 AS is_public FROM ({UNIT_PAGES})"
_INVENTORY = f"""
SELECT u.unit_id, u.pos, u.page_id, CASE WHEN d.id IS NULL OR p.page_id IS NULL THEN 'error' WHEN p.file_path IS NOT NULL AND p.is_extracted THEN 'extracted' ELSE 'to_extract' END AS state
FROM ({_SHIFTED}) u LEFT JOIN ({DOCUMENTS}) d ON d.id = u.document_id LEFT JOIN ({PAGES}) p ON p.page_id = u.page_id WHERE u.is_public
"""


@query("s4_scan_inventory", _INVENTORY)
def _(b):
    return U.scan_inventory(*shifted_units(b), pages(b), documents_of(b))


@query("s4_inventory_counts", f"SELECT state, count(*) AS pages FROM ({_INVENTORY}) GROUP BY state")
def _(b):
    return U.inventory_counts(U.scan_inventory(*shifted_units(b), pages(b), documents_of(b)))


@query(
    "s8_public_page_list",
    f"""SELECT u.unit_id, u.pos, u.page_id, p.page_number, CASE WHEN p.file_path IS NOT NULL AND p.is_extracted THEN concat('/scans/', p.document_id, '/', p.page_number, '.png') END AS image_url
    FROM ({_SHIFTED}) u JOIN ({PAGES}) p USING (page_id) WHERE u.is_public""",
)
def _(b):
    heads, u = shifted_units(b)
    return U.public_page_list(u.join(heads.where("is_public"), "unit_id", "left_semi"), pages(b))


@query(
    "u3_foreign_pages",
    f"SELECT u.unit_id, u.page_id FROM ({_SHIFTED}) u WHERE NOT EXISTS (SELECT 1 FROM a_page p WHERE p.id = u.page_id AND p.document_id = u.document_id)",
)
def _(b):
    heads, u = shifted_units(b)
    return U.foreign_pages(heads, u, pages(b))


@query(
    "j7_unassigned_pages",
    f"""SELECT p.id AS page_id, p.document_id, p.page_number, coalesce(t.text, '') AS text FROM a_page p LEFT JOIN ({S.PAGE_TEXT}) t ON t.page_id = p.id
    WHERE p.id NOT IN (SELECT page_id FROM ({UNIT_PAGES}) WHERE unit_id % 2 = 0)""",
)
def _(b):
    used = unit_pages(b).where(F.col("unit_id") % 2 == 0)
    rows = U.unassigned_pages(pages(b), used, B.page_text(b.a_box))
    return rows.select("page_id", "document_id", "page_number", "text")


@query(
    "j19_composed_units",
    f"""SELECT unit_id, n.page_numbers, t.text FROM (SELECT unit_id, string_agg(CAST(coalesce(p.page_number, 0) AS VARCHAR), ',' ORDER BY u.pos) AS page_numbers FROM ({_SHIFTED}) u LEFT JOIN a_page p ON p.id = u.page_id GROUP BY unit_id) n
    LEFT JOIN ({UNIT_TEXT}) t USING (unit_id)""",
)
def _(b):
    heads, u = shifted_units(b)
    texts = B.unit_text(unit_pages(b), B.page_text(b.a_box))
    return U.composed_units(heads, u, pages(b), texts).select("unit_id", "page_numbers", "text")


@query("p11_public_units", f"SELECT unit_id, year FROM ({UNITS}) WHERE is_public ORDER BY year DESC NULLS LAST, unit_id LIMIT 40 OFFSET 5")
def _(b):
    return U.public_units(units(b), offset=5, limit=40).select("unit_id", "year")


@query(
    "t4_public_documents",
    f"SELECT unit_id, year, {EPOCH} AS epoch FROM ({UNITS}) WHERE is_public AND {EPOCH} = '90er' ORDER BY year DESC NULLS LAST, unit_id LIMIT 10 OFFSET 2",
)
def _(b):
    return U.public_documents(units(b), "90er", offset=2, limit=10).select("unit_id", "year", "epoch")


@query(
    "t5_featured_unit",
    f"""WITH o AS (SELECT * FROM ({UNITS}) WHERE is_public ORDER BY coalesce(summary <> '', false) DESC, CASE WHEN summary <> '' THEN year END DESC NULLS LAST, unit_id DESC LIMIT 1)
    SELECT o.unit_id, o.summary, {SLUG} AS person_slug FROM o LEFT JOIN (SELECT unit_id, arg_min(name, pos) AS name FROM ({PERSONS}) GROUP BY unit_id) p USING (unit_id)""",
)
def _(b):
    return U.featured_unit(units(b), persons(b)).select("unit_id", "summary", "person_slug")


@query("p10_list_documents", f"SELECT id, title, filename FROM ({DOCUMENTS}) ORDER BY id LIMIT 10 OFFSET 4")
def _(b):
    return U.list_documents(documents_of(b), offset=4, limit=10)


@query("p14_pages_of_document", "SELECT id, page_number FROM a_page WHERE document_id = 3")
def _(b):
    return U.children_of_document(b.a_page, 3, "page_number").select("id", "page_number")


@query("p14_units_of_document", f"SELECT unit_id, title FROM ({UNITS}) WHERE document_id = 3")
def _(b):
    return U.children_of_document(units(b), 3, "unit_id").select("unit_id", "title")


@query(
    "p14_suggestions_of_document",
    "SELECT o_orderkey AS id, o_custkey AS first_page FROM orders WHERE o_custkey % 20 = 3",
)
def _(b):
    orders = b.table("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("document_id"), F.col("o_custkey").alias("first_page")
    )
    return U.children_of_document(orders, 3, "id").drop("document_id")


@query(
    "m14_accept_suggestions",
    f"""SELECT unit_id, document_id, true AS was_unit FROM ({UNITS}) UNION ALL
    SELECT (SELECT max(unit_id) FROM a_unit_page) + row_number() OVER (ORDER BY unit_id), document_id, false FROM ({_SHIFTED}) WHERE document_id = 4 AND pos = 0""",
)
def _(b):
    heads, _pages = shifted_units(b)
    suggestions = heads.select(
        F.col("unit_id").alias("id"),
        "document_id",
        F.array(F.col("unit_id") * 4).alias("page_ids"),
        F.lit(False).alias("belongs_with_next"),
    )
    first = b.a_unit_page.agg(F.max("unit_id") + 1).scalar()
    made, _left = U.accept_suggestions(units(b), suggestions, 4, first)
    return made.select("unit_id", "document_id", F.col("title").isNotNull().alias("was_unit"))


@query(
    "m21_fill_units",
    f"SELECT unit_id, CASE WHEN summary IS NULL THEN concat('Inhalt ', unit_id) ELSE summary END AS summary, CASE WHEN summary IS NULL THEN 'Thema' ELSE topic END AS topic FROM ({UNITS})",
)
def _(b):
    u = units(b).withColumn("event_date", F.lit(None).cast("string"))
    contents = u.select(
        "unit_id",
        F.concat(F.lit("Inhalt "), F.col("unit_id").cast("string")).alias("summary"),
        F.lit("Thema").alias("topic"),
        F.lit(None).cast("string").alias("place"),
        F.lit("1930").alias("event_date"),
    )
    return U.fill_units(u, contents).select("unit_id", "summary", "topic")


_ENTRIES = f"""
SELECT DISTINCT document_id, kind, {S.strip('entry')} AS entry FROM (
  SELECT unit_id % 10 AS document_id, 'phrase' AS kind, text AS entry FROM a_unit_page
  UNION ALL SELECT unit_id % 10, 'name', person_name FROM a_unit_page
  UNION ALL SELECT unit_id % 10, 'phrase', unnest(['alpha', concat('  beta', unit_id % 10), 'gamma', '']) FROM a_unit_page
  UNION ALL SELECT unit_id % 10, 'name', unnest(['Anna', ' Person 3 ']) FROM a_unit_page)
WHERE {S.strip('entry')} <> ''
"""


def _phrases(b):
    p = b.a_unit_page
    u = p.select(
        (F.col("unit_id") % 10).alias("document_id"),
        F.array("text").alias("extracted_phrases"),
        F.array("person_name").alias("extracted_names"),
    )
    settings = p.select((F.col("unit_id") % 10).alias("document_id")).distinct().select(
        "document_id",
        F.concat(F.lit("alpha,  beta"), F.col("document_id").cast("string"), F.lit("\ngamma,")).alias("typical_phrases"),
        F.lit("Anna, Person 3 ").alias("expected_names"),
    )
    return u, settings


@query("a15_merged_entries", _ENTRIES)
def _(b):
    return U.merged_entries(*_phrases(b))


@query(
    "a15_merge_phrases_names",
    f"""SELECT document_id, string_agg(entry, chr(10) ORDER BY entry) FILTER (kind = 'phrase') AS typical_phrases, string_agg(entry, ', ' ORDER BY entry) FILTER (kind = 'name') AS expected_names
    FROM ({_ENTRIES}) GROUP BY document_id""",
)
def _(b):
    return U.merge_phrases_names(*_phrases(b))


@query(
    "m18_merge_pages",
    """SELECT CAST(NULL AS BIGINT) AS parent_document_id, 1 AS is_composite, CAST(NULL AS BIGINT) AS page_number, 'Sammlung' AS filename, CAST(NULL AS BIGINT) AS page_id, CAST(NULL AS VARCHAR) AS error
    UNION ALL SELECT 900, 0, row_number() OVER (ORDER BY page_number, id), concat('band.pdf_Seite_', row_number() OVER (ORDER BY page_number, id)), id, NULL FROM a_page WHERE document_id IN (2, 3)""",
)
def _(b):
    chosen = pages(b).where(F.col("document_id").isin(2, 3))
    return U.merge_pages(pages(b), chosen, 900, "band.pdf", "Sammlung")


@query(
    "j18_cascade_delete",
    """SELECT 'pages' AS t, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM a_page WHERE document_id % 4 <> 1
    UNION ALL SELECT 'results', count(*), CAST(sum(id) AS BIGINT) FROM a_result WHERE document_id % 4 <> 1
    UNION ALL SELECT 'boxes', count(*), CAST(sum(box_index) AS BIGINT) FROM a_box WHERE page_id * 3 + 2 NOT IN (SELECT id FROM a_result WHERE document_id % 4 = 1)
    UNION ALL SELECT 'jobs', count(*), CAST(sum(id) AS BIGINT) FROM a_job WHERE document_id NOT IN (1, 5, 9, 13, 17)
    UNION ALL SELECT 'mention_boxes', count(*), CAST(sum(id) AS BIGINT) FROM a_mention WHERE page_id NOT IN (SELECT id FROM a_page WHERE document_id % 4 = 1)""",
)
def _(b):
    gone = b.a_page.where(F.col("document_id") % 4 == 1).select("document_id")
    left = U.cascade_delete(
        {
            "pages": b.a_page,
            "results": b.a_result,
            "boxes": b.a_box.select((F.col("page_id") * 3 + 2).alias("result_id"), F.col("box_index").alias("id")),
            "jobs": b.a_job,
            "mention_boxes": b.a_mention,
        },
        gone,
    )
    rows = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


_DEAD = "SELECT id FROM a_page WHERE document_id % 4 = 1"


@query(
    "j18_cascade_delete_rows",
    f"""SELECT 'documents' AS t, document_id AS id FROM a_page WHERE document_id % 4 <> 1 GROUP BY ALL
    UNION ALL SELECT 'document_metadata', document_id + 1000 FROM a_page WHERE document_id % 4 <> 1 GROUP BY ALL
    UNION ALL SELECT 'pages', id FROM a_page WHERE document_id % 4 <> 1
    UNION ALL SELECT 'results', id FROM a_result WHERE document_id % 4 <> 1
    UNION ALL SELECT 'boxes', page_id * 100000 + box_index FROM a_box WHERE page_id NOT IN ({_DEAD})
    UNION ALL SELECT 'jobs', id FROM a_job WHERE document_id % 4 <> 1
    UNION ALL SELECT 'units', unit_id FROM ({UNITS}) WHERE document_id % 4 <> 1
    UNION ALL SELECT 'mention_boxes', id FROM a_mention WHERE page_id NOT IN ({_DEAD})""",
)
def _(b):
    ids = b.a_page.select("document_id").distinct()
    left = U.cascade_delete(
        {
            "documents": ids.withColumnRenamed("document_id", "id"),
            "document_metadata": ids.select((F.col("document_id") + 1000).alias("id"), "document_id"),
            "pages": b.a_page,
            "results": b.a_result,
            "boxes": b.a_box.select(
                (F.col("page_id") * 3 + 2).alias("result_id"), (F.col("page_id") * 100000 + F.col("box_index")).alias("id")
            ),
            "jobs": b.a_job,
            "units": units(b).withColumnRenamed("unit_id", "id"),
            "mention_boxes": b.a_mention,
        },
        ids.where(F.col("document_id") % 4 == 1),
    )
    rows = [df.select(F.lit(name).alias("t"), "id") for name, df in left.items()]
    return reduce(DataFrame.unionByName, rows)


# --- notes and stories: note boxes are notes, a story takes every fifth of them ------

NOTES = "SELECT page_id * 100000 + box_index AS note_id, page_id, page_id * 3 + 2 AS result_id, box_type, text AS note_text, CASE WHEN (page_id + box_index) % 5 < 4 THEN (page_id + box_index) % 5 END AS story_id FROM a_box"
STORIES = "SELECT DISTINCT unit_id AS story_id, concat('geschichte-', unit_id) AS slug, unit_id % 2 = 0 AS is_published, unit_id % 4 = 0 AS is_featured, CASE WHEN unit_id % 3 = 0 THEN '30er' ELSE '90er' END AS epoch, (unit_id * 13) % 101 AS updated_at FROM a_unit_page"


def notes(b):
    k = (F.col("page_id") + F.col("box_index")) % 5
    note_id = F.col("page_id") * 100000 + F.col("box_index")
    return b.a_box.select(
        note_id.alias("note_id"),
        note_id.alias("id"),
        "page_id",
        (F.col("page_id") * 3 + 2).alias("result_id"),
        "box_type",
        F.col("text").alias("note_text"),
        F.when(k < 4, k).alias("story_id"),
    )


def stories(b):
    u = F.col("unit_id")
    return b.a_unit_page.select("unit_id").distinct().select(
        u.alias("story_id"),
        F.concat(F.lit("geschichte-"), u.cast("string")).alias("slug"),
        (u % 2 == 0).alias("is_published"),
        (u % 4 == 0).alias("is_featured"),
        F.when(u % 3 == 0, "30er").otherwise("90er").alias("epoch"),
        ((u * 13) % 101).alias("updated_at"),
    )


@query(
    "p8_list_notes",
    f"""SELECT n.note_id, n.page_id, p.document_id FROM ({NOTES}) n JOIN a_page p ON p.id = n.page_id WHERE box_type = 'note' AND lower(note_text) LIKE '%er%' AND story_id IS NULL
    ORDER BY note_id LIMIT 200""",
)
def _(b):
    return U.list_notes(notes(b), pages(b).drop("file_path"), search="er", unassigned=True).select(
        "note_id", "page_id", "document_id"
    )


@query(
    "j14_story_sources",
    f"""SELECT s.slug, s.story_id, n.note_id, n.note_text, p.document_id, p.page_number, u.unit_id FROM ({STORIES}) s JOIN ({NOTES}) n USING (story_id)
    LEFT JOIN a_result r ON r.id = n.result_id LEFT JOIN a_page p ON p.id = r.page_id LEFT JOIN (SELECT document_id, min(unit_id) AS unit_id FROM ({UNITS}) GROUP BY document_id) u ON u.document_id = p.document_id
    WHERE s.is_published AND n.note_text <> '' AND n.box_type = 'note'""",
)
def _(b):
    only_notes = notes(b).where(F.col("box_type") == "note")
    return U.story_sources(stories(b), only_notes.drop("page_id"), b.a_result, pages(b), units(b))


@query("t6_list_stories", f"SELECT story_id, slug FROM ({STORIES}) WHERE is_published AND epoch = '90er' ORDER BY updated_at DESC, story_id DESC LIMIT 20")
def _(b):
    return U.stories(stories(b), epoch_name="90er", limit=20).select("story_id", "slug")


@query("t6_featured_story", f"SELECT story_id, slug FROM ({STORIES}) WHERE is_published AND is_featured ORDER BY updated_at DESC, story_id DESC LIMIT 1")
def _(b):
    return U.stories(stories(b), featured=True, limit=1).select("story_id", "slug")


@query(
    "m13_assign_notes",
    f"""SELECT note_id, CASE WHEN box_type = 'note' AND hit THEN 2 WHEN box_type = 'note' AND story_id = 2 THEN NULL ELSE story_id END AS story_id
    FROM (SELECT *, note_id IN (SELECT doc_id * 100000 + 1 FROM labels WHERE quality = 1) AS hit FROM ({NOTES}))""",
)
def _(b):
    ids = b.table("labels").where("quality = 1").select((F.col("doc_id") * 100000 + 1).alias("note_id"))
    return U.assign_notes(notes(b), 2, ids).select("note_id", "story_id")


# --- people and search -----------------------------------------------------------


@query("f3_slug", f"SELECT DISTINCT name, {SLUG} AS slug FROM (SELECT person_name AS name FROM a_unit_page UNION ALL SELECT text FROM a_unit_page)")
def _(b):
    p = b.a_unit_page
    names = p.select(F.col("person_name").alias("name")).unionByName(p.select(F.col("text").alias("name")))
    return names.distinct().select("name", T.slug("name").alias("slug"))


@query("f28_epoch", f"SELECT DISTINCT unit_id, {EPOCH} AS epoch FROM a_unit_page")
def _(b):
    return b.a_unit_page.select("unit_id", U.epoch(F.col("year")).alias("epoch")).distinct()


def _snippet_sql(text: str, term: str, window: int, summary: str) -> str:
    at = f"instr(lower({text}), lower({term}))"
    start = f"greatest(0, {at} - 1 - {window})"
    end = f"least(length({text}), {at} - 1 + length({term}) + {window})"
    return f"""CASE WHEN coalesce({text}, '') = '' THEN coalesce({summary}, '') WHEN {at} = 0 THEN coalesce(nullif({summary}, ''), substr({text}, 1, {window * 2}))
      ELSE concat(CASE WHEN {start} > 0 THEN '…' ELSE '' END, substr({text}, {start} + 1, {end} - {start}), CASE WHEN {end} < length({text}) THEN '…' ELSE '' END) END"""


@query("f4_snippet", f"SELECT unit_id, pos, {_snippet_sql('text', 'chr(10)', 120, 'NULL')} AS line_end, {_snippet_sql('text', 'role', 60, 'person_name')} AS around_role FROM a_unit_page")
def _(b):
    return b.a_unit_page.select(
        "unit_id",
        "pos",
        T.snippet("text", F.lit("\n")).alias("line_end"),
        T.snippet("text", "role", "person_name", 60).alias("around_role"),
    )


_TURN_TEXT = "SELECT unit_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM a_unit_page GROUP BY unit_id"


def _search_sql(term: str) -> str:
    hit = {f: f"contains(lower(coalesce({f}, '')), '{term}')" for f in ("title", "summary", "topic", "place")}
    at = f"instr(lower(text), '{term}')"
    start, end = f"greatest(0, {at} - 61)", f"least(length(text), {at} - 1 + {len(term)} + 60)"
    cut = f"concat(CASE WHEN {start} > 0 THEN '…' ELSE '' END, substr(text, {start} + 1, {end} - {start}), CASE WHEN {end} < length(text) THEN '…' ELSE '' END)"
    return f"""
    SELECT 'document' AS type, unit_id, CAST(unit_id AS VARCHAR) AS slug, title AS display_name, {EPOCH} AS epoch, coalesce(nullif(s, ''), summary) AS snippet FROM (
      SELECT *, CASE WHEN {hit['title']} THEN NULL WHEN {hit['summary']} THEN summary WHEN {hit['topic']} THEN topic WHEN {hit['place']} THEN place WHEN {at} > 0 THEN {cut} END AS s
      FROM ({UNITS}) JOIN ({_TURN_TEXT}) USING (unit_id) WHERE is_public
        AND ({hit['title']} OR {hit['summary']} OR {hit['topic']} OR {hit['place']} OR unit_id IN (SELECT unit_id FROM a_unit_page WHERE contains(lower(text), '{term}'))))"""


@query("x2_search_documents", _search_sql("musik") + " UNION ALL " + _search_sql("wing"))
def _(b):
    results = turn_texts(b)
    args = (units(b), turns(b), results, turn_texts(b))
    return X.search_documents(*args, " Musik").unionByName(X.search_documents(*args, "wing"))


@query(
    "x2_search_people",
    f"""WITH h AS (SELECT p.*, {EPOCH} AS epoch, {SLUG} AS slug FROM ({PERSONS}) p JOIN ({UNITS}) u USING (unit_id) WHERE is_public AND (contains(lower(name), 'person 1') OR contains(lower(coalesce(summary, '')), 'person 1'))),
    f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY unit_id, pos) AS rn FROM h)
    SELECT 'person' AS type, row_number() OVER (ORDER BY unit_id, pos, slug) AS id, slug, name AS display_name, epoch, role AS snippet FROM f WHERE rn = 1""",
)
def _(b):
    return X.search_people(units(b), persons(b), "Person 1")


@query(
    "a20_person_directory",
    f"""WITH h AS (SELECT p.*, {EPOCH} AS epoch FROM ({PERSONS}) p JOIN ({UNITS}) u USING (unit_id) WHERE is_public),
    f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY unit_id, pos) AS rn FROM h), e AS (SELECT name, arg_min(epoch, unit_id * 100000 + pos) AS epoch FROM h WHERE epoch IS NOT NULL GROUP BY name)
    SELECT row_number() OVER (ORDER BY unit_id, pos, name) AS id, {SLUG} AS slug, name AS display_name, e.epoch, role AS notes FROM (SELECT * EXCLUDE (epoch) FROM f WHERE rn = 1) LEFT JOIN e USING (name)""",
)
def _(b):
    return X.person_directory(units(b), persons(b))


@query(
    "x3_person_detail",
    f"""WITH h AS (SELECT p.*, u.year, u.summary FROM ({PERSONS}) p JOIN ({UNITS}) u USING (unit_id) WHERE is_public AND name = 'Person 7'),
    f AS (SELECT * FROM h ORDER BY unit_id, pos LIMIT 1)
    SELECT 'person-7' AS slug, name AS display_name, (SELECT role FROM f) AS role, (SELECT {EPOCH} FROM f) AS epoch, unit_id, pos, year, {_snippet_sql('t.text', 'name', 120, 'summary')} AS snippet
    FROM h JOIN ({_TURN_TEXT}) t USING (unit_id) WHERE year IS NOT NULL OR coalesce(summary, '') <> ''""",
)
def _(b):
    return X.person_detail(units(b), persons(b), turns(b), turn_texts(b), "person-7")


@query(
    "x4_unit_detail",
    f"""SELECT unit_id, title, {EPOCH} AS epoch, text, n AS page_count, n AS person_count FROM ({UNITS}) JOIN ({_TURN_TEXT}) USING (unit_id) JOIN (SELECT unit_id, count(*) AS n FROM a_unit_page GROUP BY unit_id) USING (unit_id) WHERE is_public""",
)
def _(b):
    return X.unit_detail(units(b), turns(b), turn_texts(b), persons(b)).select(
        "unit_id", "title", "epoch", "text", "page_count", "person_count"
    )
