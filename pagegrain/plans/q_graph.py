"""Queries on mentions, people's events, triples, claims and the authority file."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import claims as C
from pagegrain.functions import text as T
from pagegrain.operators import graph as G
from pagegrain.operators import people as P
from pagegrain.operators.authority import match_authority
from pagegrain.plans.q_boxes import DOCUMENTS, documents_of
from pagegrain.plans.registry import query

_CLAIM, _ENT = C.CLAIM, C.ENTITY

# --- triples with images and claims for the people of a_triple ---------------------

RICH = f"""
SELECT * FROM a_triple
UNION ALL SELECT concat('Person_', c_custkey), 'mainImage', concat(' img', c_custkey, '.jpg'), 'literal' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT concat('Person_', c_custkey), 'sameAs', concat('{_ENT}Q', c_custkey), 'uri' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT concat('Person_', c_custkey), '{_CLAIM}P27', concat('{_ENT}Q', c_nationkey), 'uri' FROM customer
UNION ALL SELECT concat('Person_', c_custkey), '{_CLAIM}P106', c_mktsegment, 'literal' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT concat('Person_', c_custkey), 'claimValueLabel', concat('P27', chr(31), 'Q', c_nationkey, chr(31), ' Land ', c_nationkey), 'literal' FROM customer WHERE c_custkey % 4 <> 1
UNION ALL SELECT concat('Person_', c_custkey), 'claimValueLabel_P106', concat('Beruf ', c_mktsegment), 'literal' FROM customer WHERE c_custkey % 4 = 2
"""


def _t(df, s, p, o, kind):
    return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(kind).alias("object_type"))


def rich(b):
    c = b.table("customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    s = F.concat(F.lit("Person_"), k.cast("string"))
    ent = F.concat(F.lit(f"{_ENT}Q"), n)
    label = F.concat(F.lit("P27\x1fQ"), n, F.lit("\x1f Land "), n)
    return (
        b.a_triple.unionByName(_t(c.where(k % 3 == 0), s, "mainImage", F.concat(F.lit(" img"), k.cast("string"), F.lit(".jpg")), "literal"))
        .unionByName(_t(c.where(k % 5 == 0), s, "sameAs", F.concat(F.lit(f"{_ENT}Q"), k.cast("string")), "uri"))
        .unionByName(_t(c, s, f"{_CLAIM}P27", ent, "uri"))
        .unionByName(_t(c.where(k % 2 == 0), s, f"{_CLAIM}P106", F.col("c_mktsegment"), "literal"))
        .unionByName(_t(c.where(k % 4 != 1), s, "claimValueLabel", label, "literal"))
        .unionByName(_t(c.where(k % 4 == 2), s, "claimValueLabel_P106", F.concat(F.lit("Beruf "), F.col("c_mktsegment")), "literal"))
    )


# --- mentions ----------------------------------------------------------------------


@query("a9_pages_with_mentions", "SELECT page_id, count(*) AS box_count FROM a_mention GROUP BY page_id")
def _(b):
    return P.pages_with_mentions(b.a_mention)


_DETAILS = """
SELECT subject AS entity_uri, min(CASE WHEN predicate = 'name' THEN object END) AS name, trim(min(CASE WHEN predicate = 'mainImage' THEN object END)) AS main_image_url,
  min(CASE WHEN predicate = 'sameAs' THEN object END) AS wd FROM rich GROUP BY subject HAVING min(CASE WHEN predicate = 'name' THEN object END) IS NOT NULL
"""


@query(
    "a14_entity_catalogue",
    f"""WITH rich AS ({RICH}), d AS ({_DETAILS}),
    s AS (SELECT entity_uri, page_id, min(id) AS f FROM a_mention WHERE contains(entity_uri, 'Person_') GROUP BY ALL)
    SELECT s.entity_uri, s.entity_uri AS entity_id, coalesce(d.name, concat('Box ', min(f) OVER (PARTITION BY s.entity_uri))) AS name, d.main_image_url, page_id, row_number() OVER (PARTITION BY s.entity_uri ORDER BY f) AS pos
    FROM s LEFT JOIN d ON d.entity_uri = s.entity_uri""",
)
def _(b):
    mentions = b.a_mention.withColumn("name", F.concat(F.lit("Box "), F.col("id").cast("string")))
    return P.entity_catalogue(mentions, G.person_details(rich(b)))


_EVENTS = """SELECT * FROM a_mention WHERE event_type IS NOT NULL AND (start_date IS NULL OR year(start_date) BETWEEN 1994 AND 1997)
  AND (end_date IS NULL OR year(end_date) BETWEEN 1994 AND 1997) AND (start_date IS NOT NULL OR end_date IS NOT NULL) AND event_type IN ('president', 'gast')"""


@query("p9_filter_events", f"SELECT id, entity_uri, event_type FROM ({_EVENTS})")
def _(b):
    return P.filter_events(b.a_mention, 1994, 1997, ["president", "gast"]).select("id", "entity_uri", "event_type")


_RANK = "CASE event_type WHEN 'president' THEN 1 WHEN 'board' THEN 2 WHEN 'membership' THEN 3 WHEN 'vortrag' THEN 4 WHEN 'diskussion' THEN 5 WHEN 'gast' THEN 6 ELSE 999 END"
_IS_RANGE = "event_type IN ('president', 'board', 'membership')"


@query(
    "a19_person_timeline",
    f"""SELECT m.entity_uri, c.c_name AS person_name, min({_RANK}) OVER (PARTITION BY m.entity_uri) AS sort_rank, CASE WHEN {_IS_RANGE} THEN 'range' ELSE 'point' END AS kind,
      event_type AS type, id, page_id, epoch(start_date)::BIGINT AS start_s, epoch(coalesce(end_date, CASE WHEN {_IS_RANGE} THEN start_date END))::BIGINT AS end_s
    FROM a_mention m JOIN customer c ON m.entity_uri = concat('Person_', c_custkey) WHERE event_type IS NOT NULL""",
)
def _(b):
    rows = P.person_timeline(P.filter_events(b.a_mention), G.person_details(b.a_triple))
    return rows.select(
        "entity_uri",
        "person_name",
        "sort_rank",
        "kind",
        "type",
        "id",
        "page_id",
        F.unix_timestamp("start").alias("start_s"),
        F.unix_timestamp("end").alias("end_s"),
    )


#: The people whose companions are asked for, as one network view does.
ANCHORS = ["Person_1", "Person_2", "Person_4"]


def _anchors(b):
    return b.table("region").sparkSession.createDataFrame([(a,) for a in ANCHORS], "entity_uri string")


def _co_sql(grain: str, extra: str = "") -> str:
    return f"""WITH m AS (SELECT DISTINCT {grain} AS g, entity_uri FROM a_mention {extra} WHERE contains(entity_uri, 'Person_'))
    SELECT h.entity_uri AS anchor_uri, m.entity_uri, count(*) AS places FROM m JOIN m h USING (g) WHERE h.entity_uri IN ({', '.join(repr(a) for a in ANCHORS)}) AND m.entity_uri <> h.entity_uri GROUP BY ALL"""


@query("j13_co_mentions_source", _co_sql("source_box"))
def _(b):
    return P.co_mentions(b.a_mention, _anchors(b))


@query("j13_co_mentions_document", _co_sql("document_id", "JOIN a_page p ON p.id = page_id"))
def _(b):
    with_document = b.a_mention.join(b.a_page.select(F.col("id").alias("page_id"), "document_id"), "page_id")
    return P.co_mentions(with_document, _anchors(b), "document_id")


@query(
    "j13_co_mention_classes",
    """WITH m AS (SELECT DISTINCT source_box AS g, entity_uri FROM a_mention WHERE contains(entity_uri, 'Person_')),
    s AS (SELECT g, string_agg(entity_uri, '|' ORDER BY entity_uri) AS k, count(*) AS people FROM m GROUP BY g HAVING count(*) > 1),
    c AS (SELECT min(g) AS class_id, count(*) AS places, any_value(people) AS people FROM s GROUP BY k)
    SELECT class_id, places, people, entity_uri FROM c JOIN m ON g = class_id""",
)
def _(b):
    return P.co_mention_classes(b.a_mention)


@query(
    "j16_mention_list",
    f"""WITH rich AS ({RICH}), d AS ({_DETAILS})
    SELECT m.id, m.entity_uri, p.document_id, p.page_number, coalesce(k.title, k.filename) AS document_title, d.main_image_url
    FROM a_mention m JOIN a_page p ON p.id = m.page_id JOIN ({DOCUMENTS}) k ON k.id = p.document_id LEFT JOIN d ON d.entity_uri = m.entity_uri""",
)
def _(b):
    pages = b.a_page.select(F.col("id").alias("page_id"), "document_id", "page_number")
    rows = P.mention_list(b.a_mention, pages, documents_of(b), G.entity_details(rich(b)))
    return rows.select("id", "entity_uri", "document_id", "page_number", "document_title", "main_image_url")


_TERM_START = "coalesce(start_date, CASE WHEN event_type IN ('president', 'board') THEN make_timestamp(1999, 7, 1, 0, 0, 0) WHEN event_type = 'gast' THEN make_timestamp(1930, 5, 6, 0, 0, 0) END)"
_TERMS = f"SELECT *, coalesce(end_date, CASE WHEN event_type IN ('president', 'board') THEN make_timestamp(year(s) + 1, 6, 30, 0, 0, 0) END) AS e FROM (SELECT *, {_TERM_START} AS s FROM a_mention WHERE event_type IS NOT NULL)"


def _with_page_date(b):
    return P.filter_events(b.a_mention).withColumn("page_date", F.lit("1930-05-06").cast("timestamp"))


@query("f29_default_term", f"SELECT id, event_type, epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM ({_TERMS})")
def _(b):
    return P.default_terms(_with_page_date(b), 1999).select(
        "id", "event_type", F.unix_timestamp("start_date").alias("start_s"), F.unix_timestamp("end_date").alias("end_s")
    )


@query(
    "x13_membership_events",
    f"SELECT id, page_id, concat(event_type, ': Club_1') AS name, entity_uri AS subject_uri, 'wirdTeilVon' AS predicate_uri, 'Club_1' AS object_uri, epoch(e)::BIGINT AS end_s FROM ({_TERMS})",
)
def _(b):
    return P.membership_events(_with_page_date(b), "Club_1", 1999).select(
        "id", "page_id", "name", "subject_uri", "predicate_uri", "object_uri", F.unix_timestamp("end_date").alias("end_s")
    )


# --- triples -------------------------------------------------------------------------

_ALL = "subject, predicate, object, object_type"


@query(
    "u2_add_triples",
    f"SELECT DISTINCT {_ALL} FROM (SELECT * FROM a_triple UNION ALL SELECT subject, predicate, object, 'uri' FROM a_triple)",
)
def _(b):
    t = b.a_triple
    return G.add_triples(t, t.drop("object_type"))


STATEMENTS = """
SELECT s.subject AS statement, s.object AS subject, p.object AS predicate, o.object AS object, q.object AS source FROM a_triple s
JOIN a_triple p ON p.subject = s.subject AND p.predicate = 'statementPredicate' JOIN a_triple o ON o.subject = s.subject AND o.predicate = 'statementObject'
LEFT JOIN a_triple q ON q.subject = s.subject AND q.predicate = 'belegtIn' WHERE s.predicate = 'statementSubject'
"""


@query("j10_statements_by_subject", f"SELECT * FROM ({STATEMENTS}) WHERE subject IN (SELECT entity_uri FROM a_mention WHERE event_type = 'president')")
def _(b):
    wanted = b.a_mention.where(F.col("event_type") == "president").select(F.col("entity_uri").alias("subject"))
    return G.statements_by_subject(b.a_triple, wanted)


@query("j11_statements_by_object", STATEMENTS)
def _(b):
    return G.statements_by_object(b.a_triple)


@query(
    "j12_statement_by_source",
    f"SELECT source, statement, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY statement) AS rn FROM ({STATEMENTS}) WHERE source IS NOT NULL) WHERE rn = 1",
)
def _(b):
    return G.statement_by_source(b.a_triple)


PLACES = """
SELECT subject AS entity_uri, min(CASE WHEN predicate = 'name' THEN object END) AS name, CAST(min(CASE WHEN predicate = 'lat' THEN object END) AS DOUBLE) AS lat,
  CAST(min(CASE WHEN predicate = 'lon' THEN object END) AS DOUBLE) AS lon FROM a_triple WHERE starts_with(subject, 'Place_') GROUP BY subject
"""


@query("x5_place_details", f"SELECT * FROM ({PLACES})")
def _(b):
    return G.place_details(b.a_triple).select("entity_uri", "name", "lat", "lon")


@query(
    "x6_person_details",
    f"WITH rich AS ({RICH}), d AS ({_DETAILS}) SELECT entity_uri, name, main_image_url, replace(wd, '{_ENT}', '') AS wikidata_id FROM d WHERE starts_with(entity_uri, 'Person_')",
)
def _(b):
    return G.person_details(rich(b))


_CLAIMS = """
SELECT concat('Person_', c_custkey) AS entity_uri, 'P27' AS prop_id, concat('Q', c_nationkey) AS value, CASE WHEN c_custkey % 4 <> 1 THEN concat('Land ', c_nationkey) END AS label FROM customer
UNION ALL SELECT concat('Person_', c_custkey), 'P106', c_mktsegment, CASE WHEN c_custkey % 4 = 2 THEN concat('Beruf ', c_mktsegment) END FROM customer WHERE c_custkey % 2 = 0
"""


@query("x6_person_claims", _CLAIMS)
def _(b):
    return G.entity_claims(rich(b))


@query(
    "x7_entity_preview",
    f"""WITH rich AS ({RICH}), d AS ({_DETAILS}) SELECT d.entity_uri, d.name, CASE WHEN starts_with(d.entity_uri, 'Place_') THEN 'place' ELSE 'person' END AS kind, replace(d.wd, '{_ENT}', '') AS wikidata_id, d.main_image_url, c.prop_id, c.value
    FROM d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_uri ORDER BY prop_id, value) AS rn FROM ({_CLAIMS})) c ON c.entity_uri = d.entity_uri AND c.rn <= 20""",
)
def _(b):
    return G.entity_preview(rich(b))


@query(
    "x8_find_by_name",
    """SELECT n.name, n.kind, min(t.subject) AS entity_uri FROM (SELECT concat(' ', n_name) AS name, 'place' AS kind FROM nation UNION ALL SELECT c_name, 'person' FROM customer UNION ALL SELECT c_name, 'event' FROM customer) n
    JOIN a_triple t ON t.predicate = 'name' AND t.object = trim(n.name) WHERE n.kind = 'person' OR (n.kind = 'place' AND starts_with(t.subject, 'Place_')) GROUP BY n.name, n.kind""",
)
def _(b):
    people = b.table("customer").select(F.col("c_name").alias("name"))
    names = (
        b.table("nation")
        .select(F.concat(F.lit(" "), F.col("n_name")).alias("name"), F.lit("place").alias("kind"))
        .unionByName(people.withColumn("kind", F.lit("person")))
        .unionByName(people.withColumn("kind", F.lit("event")))
    )
    return G.find_by_name(names, b.a_triple)


@query(
    "t7_suggest_entities",
    "SELECT subject AS uri, object AS name FROM a_triple WHERE predicate = 'name' AND contains(lower(object), 'customer#0000001') AND starts_with(subject, 'Person_') ORDER BY name, uri LIMIT 50",
)
def _(b):
    return G.suggest_entities(b.a_triple, " Customer#0000001", "person", 80)


@query(
    "x9_list_triples",
    "SELECT subject, predicate, object, 'literal' AS object_type FROM a_triple WHERE predicate = 'statementObject' ORDER BY subject, predicate, object LIMIT 60",
)
def _(b):
    return G.list_triples(b.a_triple, predicate="statementObject", limit=60)


def _document_triples(b):
    m = b.a_mention
    doc = F.concat(F.lit("Document_"), (F.col("page_id") % 20).cast("string"))
    kind = T.entity_kind("entity_uri")
    return _t(m, doc, "erwaehnt", F.col("entity_uri"), "uri").unionByName(
        _t(m, F.col("entity_uri"), "entityType", kind, "literal")
    )


@query(
    "x10_document_entities",
    "SELECT DISTINCT concat('Document_', page_id % 20) AS document, entity_uri AS entity, CASE WHEN starts_with(entity_uri, 'Place_') THEN 'place' ELSE 'person' END AS type FROM a_mention",
)
def _(b):
    return G.document_entities(G.add_triples(_document_triples(b), _document_triples(b)))


@query("x10_entity_documents", "SELECT DISTINCT entity_uri AS entity, concat('Document_', page_id % 20) AS document FROM a_mention")
def _(b):
    return G.entity_documents(_document_triples(b))


_SHOWN = f"SELECT * FROM ({PLACES}) WHERE lat IS NOT NULL AND lon IS NOT NULL AND entity_uri IN (SELECT entity_uri FROM a_mention)"


@query("j17_place_map", f"SELECT entity_uri AS place_uri, name, lat, lon FROM ({_SHOWN})")
def _(b):
    places, _links = G.place_map(b.a_mention, b.a_triple)
    return places.select(F.col("entity_uri").alias("place_uri"), "name", "lat", "lon")


@query(
    "j17_place_links",
    f"""WITH s AS (SELECT entity_uri AS u FROM ({_SHOWN})), r AS (SELECT object AS u, subject, CASE predicate WHEN 'P551' THEN 'residence' WHEN 'P937' THEN 'work' ELSE 'event' END AS relation FROM ({STATEMENTS}))
    SELECT DISTINCT u AS place_uri, 'page' AS item, CAST(page_id AS VARCHAR) AS value, NULL AS label, NULL AS relation FROM s JOIN a_mention m ON m.entity_uri = u
    UNION ALL SELECT DISTINCT u, 'relation', relation, NULL, relation FROM s JOIN r USING (u)
    UNION ALL SELECT DISTINCT u, 'person', subject, c_name, relation FROM s JOIN r USING (u) JOIN customer ON subject = concat('Person_', c_custkey) WHERE relation <> 'event'""",
)
def _(b):
    _places, links = G.place_map(b.a_mention, b.a_triple)
    return links


_FRESH_CLAIM = f"concat('{_CLAIM}', 'P569')"


@query(
    "m15_upsert_person",
    f"""WITH rich AS ({RICH}), p AS (SELECT concat('Person_', c_custkey) AS u, c_custkey AS k FROM customer WHERE c_acctbal < 0)
    SELECT DISTINCT r.{', r.'.join(_ALL.split(', '))} FROM rich r LEFT JOIN p ON p.u = r.subject
    WHERE p.u IS NULL OR NOT (predicate = 'name' OR (predicate = 'sameAs' AND k % 2 = 0) OR starts_with(predicate, '{_CLAIM}') OR starts_with(predicate, 'claimValueLabel') OR (predicate = 'mainImage' AND k % 4 = 0))
    UNION SELECT u, 'name', concat('Neu ', k), 'literal' FROM p UNION SELECT u, 'sameAs', concat('{_ENT}Q9', k), 'uri' FROM p WHERE k % 2 = 0
    UNION SELECT u, 'mainImage', concat('neu', k), 'literal' FROM p WHERE k % 4 = 0
    UNION SELECT u, {_FRESH_CLAIM}, '1950-01-01', 'literal' FROM p UNION SELECT u, concat('{_CLAIM}', 'P27'), '{_ENT}Q183', 'uri' FROM p
    UNION SELECT u, 'claimValueLabel', concat('P27', chr(31), 'Q183', chr(31), 'Land'), 'literal' FROM p""",
)
def _(b):
    k = F.col("c_custkey")
    people = b.table("customer").where(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("Person_"), k.cast("string")).alias("entity_uri"),
        F.concat(F.lit("Neu "), k.cast("string")).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("Q9"), k.cast("string"))).alias("wikidata_id"),
        F.concat(F.lit(" neu"), k.cast("string")).alias("main_image_url"),
        (k % 4 == 0).alias("update_main_image"),
    )
    def claim(prop, value, label):
        return F.struct(
            F.lit(prop).alias("prop_id"), F.lit(value).alias("value"), F.lit(label).cast("string").alias("value_label")
        )

    given = F.array(claim("P569", " 1950-01-01 ", None), claim("P27", "Q183", "Land"), claim("P19", " ", "leer"))
    claims = people.select("entity_uri", F.inline(given))
    return G.upsert_person(rich(b), people, claims)


@query(
    "m15_upsert_place",
    f"""WITH p AS (SELECT concat('Place_', n_nationkey) AS u, n_nationkey AS k, n_name FROM nation WHERE n_nationkey % 2 = 0)
    SELECT {_ALL} FROM a_triple WHERE subject NOT IN (SELECT u FROM p)
    UNION SELECT u, 'name', concat(n_name, ' neu'), 'literal' FROM p UNION SELECT u, 'lat', CAST(k + 0.5 AS VARCHAR), 'literal' FROM p WHERE k % 4 = 0
    UNION SELECT u, 'adressbuchPage', 'S. 7', 'literal' FROM p""",
)
def _(b):
    k = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    places = b.table("nation").where(k % 2 == 0).select(
        F.concat(F.lit("Place_"), k.cast("string")).alias("entity_uri"),
        F.concat(F.col("n_name"), F.lit(" neu")).alias("name"),
        none.alias("wikidata_id"),
        none.alias("main_image_url"),
        F.lit(True).alias("update_main_image"),
        F.when(k % 4 == 0, (k + 0.5).cast("string")).alias("lat"),
        none.alias("lon"),
        F.lit(" ").alias("historical_address"),
        none.alias("adressbuch_url"),
        F.lit("S. 7").alias("adressbuch_page"),
    )
    return G.upsert_place(b.a_triple, places)


_GONE = "SELECT subject FROM a_triple WHERE predicate = 'belegtIn' AND object IN (SELECT concat('Box_', source_box % 40) FROM a_mention WHERE event_type = 'gast')"


def _gone(b):
    return b.a_mention.where(F.col("event_type") == "gast").select(
        F.concat(F.lit("Box_"), (F.col("source_box") % 40).cast("string")).alias("source")
    )


@query("m16_remove_statements", f"SELECT {_ALL} FROM a_triple WHERE subject NOT IN ({_GONE})")
def _(b):
    return G.remove_statements(b.a_triple, _gone(b))


@query("m16_removed_count", f"SELECT count(*) AS removed FROM a_triple WHERE subject IN ({_GONE})")
def _(b):
    return G.removed_statements(b.a_triple, _gone(b))


def _nodes(b):
    i = F.col("id").cast("string")
    return b.a_mention.select(
        F.concat(F.lit("Node_"), i).alias("node_uri"),
        F.concat(F.lit("Node_"), i).alias("mention_uri"),
        F.concat(F.lit("Node_"), i).alias("statement_uri"),
        "entity_uri",
        F.concat(F.lit("Box_"), F.col("source_box").cast("string")).alias("source_uri"),
        F.concat(F.lit("Page_"), F.col("page_id").cast("string")).alias("page_uri"),
        F.col("event_type").alias("role"),
        F.col("entity_uri").alias("subject"),
        F.lit("P551").alias("predicate"),
        F.lit("Place_1").alias("object"),
    )


_N = "concat('Node_', id)"


@query(
    "m17_add_mentions",
    f"""SELECT {_N} AS subject, 'beziehtSichAuf' AS predicate, entity_uri AS object, 'uri' AS object_type FROM a_mention UNION ALL SELECT {_N}, 'belegtIn', concat('Box_', source_box), 'uri' FROM a_mention
    UNION ALL SELECT {_N}, 'rolle', event_type, 'literal' FROM a_mention WHERE event_type IS NOT NULL""",
)
def _(b):
    return G.mention_triples(_nodes(b))


@query(
    "m17_add_sources",
    f"""SELECT {_N} AS subject, 'belegtIn' AS predicate, concat('Box_', source_box) AS object, 'uri' AS object_type FROM a_mention UNION ALL SELECT {_N}, 'aussageSubjekt', entity_uri, 'uri' FROM a_mention
    UNION ALL SELECT {_N}, 'aussagePraedikat', 'P551', 'uri' FROM a_mention UNION ALL SELECT {_N}, 'aussageObjekt', 'Place_1', 'uri' FROM a_mention""",
)
def _(b):
    return G.source_triples(_nodes(b))


@query(
    "m17_add_statements",
    f"""SELECT {_N} AS subject, 'statementSubject' AS predicate, entity_uri AS object, 'uri' AS object_type FROM a_mention UNION ALL SELECT {_N}, 'statementPredicate', 'P551', 'uri' FROM a_mention
    UNION ALL SELECT {_N}, 'statementObject', 'Place_1', 'uri' FROM a_mention UNION ALL SELECT {_N}, 'belegtIn', concat('Box_', source_box), 'uri' FROM a_mention UNION ALL SELECT {_N}, 'belegtIn', concat('Page_', page_id), 'uri' FROM a_mention""",
)
def _(b):
    return G.statement_triples(_nodes(b))


_WD = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('Q', c_custkey) END"
_IMAGE = "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' http://img/', c_custkey, ' ') END"
_NEW = f"SELECT concat('Event_', c_custkey) AS uri, c_name, {_WD} AS wd, {_IMAGE} AS image FROM customer UNION ALL SELECT concat('Club_', c_custkey), c_name, {_WD}, NULL FROM customer WHERE c_custkey % 5 = 0"


@query(
    "m17_add_events_and_clubs",
    f"""SELECT uri AS subject, 'name' AS predicate, c_name AS object, 'literal' AS object_type FROM ({_NEW})
    UNION ALL SELECT uri, 'sameAs', concat('{C.ENTITY}', wd), 'uri' FROM ({_NEW}) WHERE wd IS NOT NULL
    UNION ALL SELECT uri, 'mainImage', trim(image), 'literal' FROM ({_NEW}) WHERE trim(image) <> ''""",
)
def _(b):
    k = F.col("c_custkey")
    key = k.cast("string")
    wikidata = F.when(k % 3 != 0, F.concat(F.lit("Q"), key)).alias("wikidata_id")
    image = F.when(k % 4 == 1, "  ").when(k % 4 > 1, F.concat(F.lit(" http://img/"), key, F.lit(" ")))
    people = b.table("customer")
    events = people.select(F.concat(F.lit("Event_"), key).alias("entity_uri"), F.col("c_name").alias("name"), wikidata, image.alias("main_image_url"))
    clubs = people.where(k % 5 == 0).select(
        F.concat(F.lit("Club_"), key).alias("entity_uri"), F.col("c_name").alias("name"), wikidata, F.lit(None).cast("string").alias("main_image_url")
    )
    return G.entity_triples(events.unionByName(clubs))


@query(
    "m17_place_links",
    f"""SELECT concat('Statement_', sha256(concat(entity_uri, '|', p, '|', 'Place_1', '|', 'Box_', source_box))) AS statement_uri, entity_uri AS subject, concat('{_CLAIM}', p) AS predicate, 'Place_1' AS object
    FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'P551' WHEN 1 THEN 'P937' ELSE 'P276' END AS p FROM a_mention) WHERE p <> 'P276' AND contains(entity_uri, 'Person_')""",
)
def _(b):
    i = F.col("id") % 3
    links = b.a_mention.select(
        F.col("entity_uri").alias("subject"),
        F.when(i == 0, "P551").when(i == 1, "P937").otherwise("P276").alias("property_id"),
        F.lit("Place_1").alias("place_uri"),
        F.concat(F.lit("Box_"), F.col("source_box").cast("string")).alias("source_uri"),
        F.lit(None).cast("string").alias("page_uri"),
    )
    return G.place_links(links).select("statement_uri", "subject", "predicate", "object")


@query(
    "x12_resolve_mentions",
    """SELECT o_orderkey AS id, coalesce(t.u, concat('Person_', sha256(concat('person|', n.name)))) AS entity_uri, t.u IS NULL AS is_new
    FROM (SELECT *, concat('Customer#', lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0')) AS name FROM orders) n LEFT JOIN (SELECT object, min(subject) AS u FROM a_triple WHERE predicate = 'name' GROUP BY object) t ON t.object = n.name""",
)
def _(b):
    boxes = b.table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit("person").alias("kind"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("name"),
    )
    return G.resolve_mentions(boxes, b.a_triple).select("id", "entity_uri", "is_new")


@query("f17_entity_kind", "SELECT DISTINCT entity_uri, CASE WHEN starts_with(entity_uri, 'Place_') THEN 'place' ELSE 'person' END AS kind, entity_uri AS local_id FROM a_mention")
def _(b):
    base = F.concat(F.lit("http://x.org/a/"), F.col("entity_uri"), F.lit("#me"))
    return b.a_mention.select("entity_uri", T.entity_kind(base).alias("kind"), T.local_id(base).alias("local_id")).distinct()


# --- authority file ------------------------------------------------------------------------

_ENTITIES = """
SELECT s_suppkey AS entity_id, CASE s_suppkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 2) ELSE concat('old ', p_name) END AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'STAND' ELSE '' END AS context, 'place' AS kind FROM supplier JOIN part ON p_partkey = s_suppkey
"""


def _entities(b):
    s = F.col("s_suppkey")
    name = F.col("p_name")
    return b.table("supplier").join(b.table("part"), F.col("p_partkey") == s).select(
        s.alias("entity_id"),
        F.when(s % 3 == 0, F.upper(name)).when(s % 3 == 1, F.split_part(name, F.lit(" "), F.lit(2))).otherwise(F.concat(F.lit("old "), name)).alias("name"),
        F.when(s % 2 == 0, "STAND").otherwise("").alias("context"),
        F.lit("place").alias("kind"),
    )


@query(
    "x11_match_authority",
    f"""WITH e AS ({_ENTITIES.strip()}), m AS (SELECT e.*, p_partkey AS candidate_id, p_name AS label, least(1.0, CASE WHEN lower(name) = lower(p_name) THEN 0.5 WHEN contains(lower(p_name), lower(name)) OR contains(lower(name), lower(p_name)) THEN 0.3 ELSE 0.0 END
      + CASE WHEN context <> '' AND contains(lower(p_type), lower(context)) THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(lower(p_type), 'stadt|ort|place') THEN 0.1 ELSE 0.0 END) AS score
      FROM e JOIN part ON contains(lower(p_name), lower(name)) OR contains(lower(name), lower(p_name))),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, candidate_id) AS rank FROM m)
    SELECT entity_id, name, candidate_id, label, CAST(round(score, 3) AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""",
)
def _(b):
    candidates = b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("description"))
    return match_authority(_entities(b), candidates).withColumns(
        {"score": F.round("score", 3), "rank": F.col("rank").cast("long")}
    )
