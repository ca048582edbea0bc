"""Queries on sources, web pages, model answers, claims and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagegrain.functions import claims as C
from pagegrain.functions import parsing as P
from pagegrain.functions import web as W
from pagegrain.operators import quality as Q
from pagegrain.operators import spread
from pagegrain.plans import sqlbits as S
from pagegrain.plans.bindings import A_JOB
from pagegrain.plans.registry import query
from pagegrain.plans.scratch import shared_folder
from pagegrain.sources import archive, grounding, ntriples
from pagegrain.streaming import jobs as stream

_BOX = "page_id, box_index"


# --- scans and box lists -----------------------------------------------------------


@query("s1_read_archive", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND n_chars > 500")
def _(b):
    path = f"{b.sf_dir}/documents.parquet"
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    df = archive.read_archive(b.spark, path, schema)
    return df.where((F.col("lang") == "de") & (F.col("n_chars") > 500)).select("doc_id", "lang", "n_chars")


def box_documents(b):
    """Each page's boxes as one JSON text; every 11th page is broken, every 13th is no list."""
    box = F.to_json(
        F.struct(
            F.when(F.col("box_type") != "ocr", F.col("box_type")).alias("box_type"),
            F.array("x1", "y1", "x2", "y2").alias("bbox_pixel"),
            "text",
            "review_status",
            F.col("persistent").alias("persistent_multibox_region"),
            F.when(F.col("box_index") % 2 == 0, "2024-05-01T10:20:30Z").otherwise("gestern").alias("reviewed_at"),
        )
    )
    lists = spread.ordered_concat(
        b.a_box.withColumn("_j", box), ["page_id"], ["box_index"], spread.int_bucket("box_index", 512), "_j", ", 7, "
    )
    page = F.col("page_id")
    return lists.select(
        page.alias("id"),
        F.when(page % 11 == 0, F.concat(F.lit("[{"), F.col("text")))
        .when(page % 13 == 0, F.lit('{"text": "no list"}'))
        .otherwise(F.concat(F.lit("["), F.col("text"), F.lit(', "x"]')))
        .alias("bbox_data"),
    )


@query(
    "s2_explode_boxes",
    f"SELECT page_id AS ocr_result_id, box_index, box_index * 2 AS pos, box_type, x1, y2, text, review_status, persistent, CASE WHEN box_index % 2 = 0 THEN epoch(TIMESTAMP '2024-05-01 10:20:30')::BIGINT END AS reviewed_s FROM a_box WHERE page_id % 11 <> 0 AND page_id % 13 <> 0",
)
def _(b):
    rows = archive.explode_boxes(box_documents(b))
    return rows.select(
        "ocr_result_id", "box_index", "pos", "box_type", "x1", "y2", "text", "review_status", "persistent",
        F.unix_timestamp("reviewed_at").alias("reviewed_s"),
    )


@query("s3_triples_round_trip", "SELECT DISTINCT subject, predicate, object, object_type FROM a_triple")
def _(b):
    return ntriples.parse_ntriples(ntriples.format_ntriples(b.a_triple)).dropDuplicates()


@query("s3_triple_files", "SELECT subject, predicate, object, object_type FROM a_triple")
def _(b):
    path = shared_folder(b.spark, "triples")
    ntriples.write_triples(b.a_triple, path)
    return ntriples.read_triples(b.spark, path)


@query(
    "s6_native_text_box",
    f"SELECT page_id, 'pdf_native' AS source, {S.strip('text')} AS text, 800 + page_id % 7 AS x2, 1100 AS y2 FROM (SELECT doc_id AS page_id, text FROM documents) WHERE {S.strip('text')} <> ''",
)
def _(b):
    pages = b.table("documents").withColumnRenamed("doc_id", "page_id").select(
        "page_id", "text", (F.col("page_id") % 7 + 800).alias("width"), F.lit(1100).cast("long").alias("height")
    )
    return archive.native_text_boxes(pages).select("page_id", "source", "text", "x2", "y2").withColumn("y2", F.col("y2").cast("int"))


# A vision model's answer per page: every line marked with its box.
MARKED = f"""
SELECT page_id, box_index, replace(text, '<', ' ') AS t, CASE WHEN box_index % 5 = 4 THEN 0 ELSE x1 END AS x1, CASE WHEN box_index % 5 = 3 THEN 0 ELSE y1 END AS y1,
  CASE WHEN box_index % 5 = 4 THEN 0 ELSE x2 END AS x2, CASE WHEN box_index % 5 = 3 THEN 0 WHEN box_index % 5 = 2 THEN y1 ELSE y2 END AS y2 FROM a_box
"""


@query(
    "s7_parse_grounding",
    f"""WITH f AS (SELECT page_id, box_index AS det_index, CASE WHEN {S.strip('t')} <> '' THEN {S.strip('t')} ELSE 'zeile' END AS text, x1, y1,
      CASE WHEN x1 = 0 AND x2 = 0 THEN 1000 ELSE x2 END AS x2, CASE WHEN y1 = 0 AND y2 = 0 THEN 1600 ELSE y2 END AS y2 FROM ({MARKED}) WHERE x1 + y1 + x2 + y2 > 0)
    SELECT page_id, det_index, text, x1, y1, x2, y2, x2 / 1000 AS rel_x2 FROM f WHERE x1 < x2 AND y1 < y2""",
)
def _(b):
    i = F.col("box_index") % 5
    zero = F.lit(0).cast("long")
    marked = b.a_box.withColumns(
        {
            "t": F.replace(F.col("text"), F.lit("<"), F.lit(" ")),
            "y2": F.when(i == 3, zero).when(i == 2, F.col("y1")).otherwise(F.col("y2")),
            "y1": F.when(i == 3, zero).otherwise(F.col("y1")),
            "x1": F.when(i == 4, zero).otherwise(F.col("x1")),
            "x2": F.when(i == 4, zero).otherwise(F.col("x2")),
        }
    )
    one = F.format_string("<|ref|>zeile<|/ref|><|det|>[[%d, %d,%d, %d]]<|/det|>\n%s", "x1", "y1", "x2", "y2", "t")
    answers = spread.ordered_concat(
        marked.withColumn("_m", one), ["page_id"], ["box_index"], spread.int_bucket("box_index", 512), "_m", "\n", "answer"
    )
    answers = answers.withColumns({"width": F.lit(S.WIDTH).cast("long"), "height": F.lit(S.HEIGHT).cast("long")})
    return grounding.parse_grounding(answers).select("page_id", "det_index", "text", "x1", "y1", "x2", "y2", F.col("rel_x2"))


@query(
    "a16_mean_word_confidence",
    "SELECT page_id AS result_id, round(avg(CASE WHEN c > 0 THEN c END) / 100, 6) AS confidence FROM (SELECT page_id, CASE WHEN box_index % 6 = 0 THEN -1 ELSE (page_id + box_index * 17) % 100 END AS c FROM a_box) GROUP BY page_id",
)
def _(b):
    conf = F.when(F.col("box_index") % 6 == 0, "-1").otherwise(
        F.concat(((F.col("page_id") + F.col("box_index") * 17) % 100).cast("string"), F.lit(".4"))
    )
    rows = Q.mean_word_confidence(b.a_box.select(F.col("page_id").alias("result_id"), conf.alias("conf")))
    return rows.withColumn("confidence", F.round("confidence", 6))


# --- web pages ------------------------------------------------------------------------



def _plain(html: str) -> str:
    no_tags = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    return S.strip(f"regexp_replace({no_tags}, '[{S.WS}]+', ' ', 'g')")


@query("f5_strip_html", f"SELECT page_id, {_plain('html')} AS plain FROM pages")
def _(b):
    return b.table("pages").select("page_id", W.strip_html("html").alias("plain"))


@query(
    "f6_og_image",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '.png') END AS image FROM pages",
)
def _(b):
    tag = F.concat(F.lit("<META name='x' Property='og:image' CONTENT=\" "), F.col("url"), F.lit('.png">'))
    html = F.when(F.col("page_id") % 3 == 0, F.concat(tag, F.col("html"))).otherwise(F.col("html"))
    return b.table("pages").select("page_id", W.og_image(html).alias("image"))


_LINK = """(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""


@query(
    "f7_html_links",
    f"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS t, generate_subscripts(regexp_extract_all(html, '{_LINK}', 1), 1) - 1 AS pos FROM pages),
    y AS (SELECT page_id, pos, CASE WHEN starts_with({S.strip('href')}, '/') AND NOT starts_with({S.strip('href')}, '//') THEN concat('https://site.org', {S.strip('href')}) ELSE {S.strip('href')} END AS href, {_plain('t')} AS title FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY pos) AS rn FROM y WHERE title <> '' AND NOT contains(href, '/login')),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM z WHERE rn = 1)
    SELECT page_id, pos, href, title FROM k WHERE n <= 5""",
)
def _(b):
    rows = W.html_links(b.table("pages"), ["page_id"], "html", "https://site.org", deny=["/login"], limit=5)
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "title")


@query(
    "f8_image_urls_in_json",
    "SELECT page_id, concat(url, '.PNG') AS url FROM pages UNION ALL SELECT page_id, concat('http://h.org/iiif/', page_id) FROM pages",
)
def _(b):
    page = F.struct(
        F.struct(F.array(F.concat(F.col("url"), F.lit(".PNG"))).alias("http://key.png")).alias("a"),
        F.col("url").alias("plain"),
        F.concat(F.lit(" http://h.org/iiif/"), F.col("page_id").cast("string")).alias("c"),
        "html",
    )
    docs = b.table("pages").select("page_id", F.to_json(page).alias("doc"))
    return W.image_urls_in_json(docs, ["page_id"], "doc")


@query(
    "f9_commons_url",
    "SELECT p_partkey, concat(p_name, ' (Ä)~x.jpg') AS media, concat('https://commons.wikimedia.org/wiki/Special:FilePath/', url_encode(concat(replace(p_name, ' ', '_'), '_(Ä)~x.jpg')), '?width=200') AS url FROM part",
)
def _(b):
    raw = F.concat(F.lit(" File: "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_(Ä)~x.jpg "))
    return b.table("part").select("p_partkey", C.media_name(raw).alias("media"), C.media_url(raw, 200).alias("url"))


@query(
    "f10_cache_key",
    "SELECT sha256(p_name) AS cache_key, p_name AS source_key, min(p_partkey) AS id, concat('u', min(p_partkey)) AS source_url FROM part GROUP BY p_name",
)
def _(b):
    src = b.table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("source_key"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("source_url")
    )
    return W.cached_images(src)


@query(
    "f10_variant_sizes",
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '64,128,256,512' WHEN p_size = 32 THEN '32' ELSE concat(least(p_size, 32), ',', greatest(p_size, 32)) END AS sizes FROM part",
)
def _(b):
    s = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("x, -"), s)).otherwise(F.concat(s, F.lit(" ,32,0,"), s))
    return b.table("part").select("p_partkey", F.array_join(W.variant_sizes(raw), ",").alias("sizes"))


# --- times, confidences, answers --------------------------------------------------------

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _day(b):
    return b.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "f30_claim_date",
    f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_DAY} WHEN 1 THEN {_DAY} WHEN 2 THEN concat('-', {_DAY}) END AS value FROM orders",
)
def _(b):
    k, d = F.col("o_orderkey") % 4, F.col("day")
    raw = (
        F.when(k == 0, F.concat(F.lit("+"), d, F.lit("T00:00:00Z")))
        .when(k == 1, F.concat(F.lit(" "), d))
        .when(k == 2, F.concat(F.lit("-"), d, F.lit("T00:00:00Z")))
        .otherwise(F.concat(F.lit("ca. "), d))
    )
    return _day(b).select("o_orderkey", C.claim_date(raw).alias("value"))


@query(
    "f31_parse_iso",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN epoch(date_trunc('day', o_orderdate))::BIGINT + 37230 WHEN 1 THEN epoch(date_trunc('day', o_orderdate))::BIGINT END AS s FROM orders",
)
def _(b):
    k, d = F.col("o_orderkey") % 3, F.col("day")
    raw = F.when(k == 0, F.concat(d, F.lit("T10:20:30Z"))).when(k == 1, d).otherwise(F.concat(d, F.lit(" um zehn")))
    return _day(b).select("o_orderkey", F.unix_timestamp(P.parse_iso(raw)).alias("s"))


_CONFIDENCE = {
    0: ("concat(p, '%')", "p / 100"),
    1: ("'0.85'", "0.85"),
    2: ("' Sehr gut '", "0.9"),
    3: ("'mäßig'", "0.6"),
    4: ("'low'", "0.3"),
    5: ("'vielleicht'", "0.5"),
    6: ("'17'", "1.0"),
    7: ("''", "0.5"),
}


@query(
    "f33_parse_confidence",
    "SELECT page_id, box_index, CAST(CASE k "
    + " ".join(f"WHEN {k} THEN {v[1]}" for k, v in _CONFIDENCE.items())
    + " END AS DOUBLE) AS confidence FROM (SELECT page_id, box_index, (page_id + box_index) % 8 AS k, box_index % 101 AS p FROM a_box)",
)
def _(b):
    raw = F.expr("CASE (page_id + box_index) % 8 " + " ".join(f"WHEN {k} THEN {v[0].replace('p,', 'box_index % 101,')}" for k, v in _CONFIDENCE.items()) + " END")
    return b.a_box.select("page_id", "box_index", P.parse_confidence(raw).alias("confidence"))


@query(
    "f32_parse_review_json",
    f"""SELECT {_BOX}, CASE WHEN k < 4 THEN {S.strip('text')} END AS corrected_text, CASE WHEN k < 4 THEN (box_index % 101) / 100 END AS confidence,
      CASE WHEN k < 4 THEN box_index % 2 = 0 END AS auto_confirm, CASE WHEN k < 4 THEN 'r' END AS reason FROM (SELECT *, (page_id + box_index) % 6 AS k FROM a_box)""",
)
def _(b):
    obj = F.to_json(
        F.struct(
            F.col("text").alias("corrected_text"),
            F.concat((F.col("box_index") % 101).cast("string"), F.lit(" %")).alias("confidence"),
            (F.col("box_index") % 2 == 0).alias("auto_confirm"),
            F.lit(" r ").alias("reason"),
        )
    )
    k = (F.col("page_id") + F.col("box_index")) % 6
    raw = (
        F.when(k == 0, obj)
        .when(k == 1, F.concat(obj, F.lit("\nDas war es.")))
        .when(k == 2, F.concat(F.lit("Hier:\n```json\n"), obj, F.lit("\n```\n")))
        .when(k == 3, F.concat(F.lit("Antwort: "), obj, F.lit(" Ende")))
        .when(k == 4, F.lit('{"text": 1}'))
        .otherwise(F.lit("keine Antwort"))
    )
    rows = P.parse_review_json(b.a_box.withColumn("answer", raw), "answer")
    return rows.select("page_id", "box_index", "corrected_text", "confidence", "auto_confirm", "reason")


@query(
    "f34_parse_unit_json",
    f"""SELECT unit_id, pos, CASE WHEN ok THEN nullif({S.strip('text')}, '') END AS summary, CASE WHEN ok THEN belongs_with_next END AS belongs_with_next, CASE WHEN ok THEN person_name END AS first_name,
      CASE WHEN ok THEN CASE WHEN role = 'user' THEN 'Referent' ELSE 'andere' END END AS first_role, CASE WHEN ok THEN 1 END AS people, CASE WHEN ok THEN 2 END AS names
    FROM (SELECT *, (unit_id + pos) % 4 < 3 AS ok FROM a_unit_page)""",
)
def _(b):
    p = b.a_unit_page
    obj = F.to_json(F.struct("belongs_with_next", F.col("text").alias("summary"), *_unit_fields()))
    k = (F.col("unit_id") + F.col("pos")) % 4
    raw = (
        F.when(k == 0, obj)
        .when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Text davor "), obj, F.lit(" und {danach}")))
        .otherwise(F.lit("nichts { zu sehen"))
    )
    rows = P.parse_unit_json(p.withColumn("answer", raw), "answer")
    return rows.select(
        "unit_id",
        "pos",
        "summary",
        F.col("belongs_with_next"),
        F.col("persons")[0]["name"].alias("first_name"),
        F.col("persons")[0]["role"].alias("first_role"),
        F.when(F.col("persons").isNotNull(), F.size("persons")).alias("people"),
        F.when(F.col("extracted_names").isNotNull(), F.size("extracted_names")).alias("names"),
    )


def _unit_fields():
    role = F.when(F.col("role") == "user", "Referent").otherwise("Gast").alias("role")
    return [
        F.lit("  ").alias("topic"),
        F.array(
            F.struct(F.concat(F.lit(" "), F.col("person_name")).alias("name"), role),
            F.struct(F.lit("").alias("name"), F.lit("Referent").alias("role")),
        ).alias("persons"),
        F.array("person_name", F.lit("x")).alias("extracted_names"),
    ]


# --- claims of an authority file: one document per customer -------------------------------


def claim_documents(b):
    """Birth date, nation, coordinates and image of each customer as a claims document."""
    doc = F.format_string(
        """{"P569": [{"mainsnak": {"snaktype": "novalue"}}, {"mainsnak": {"snaktype": "value", "datatype": "time", "datavalue": {"value": {"time": "+19%02d-05-0%dT00:00:00Z"}}}}],
        "P27": [{"mainsnak": {"snaktype": "value", "datatype": "wikibase-item", "datavalue": {"value": {"id": "Q%d"}}}}],
        "P1082": [{"mainsnak": {"snaktype": "value", "datatype": "quantity", "datavalue": {"value": {"amount": "+%d"}}}}],
        "P625": [{"mainsnak": {"snaktype": "value", "datatype": "globe-coordinate", "datavalue": {"value": {"latitude": %d.5, "longitude": 13}}}}],
        "P18": [{"mainsnak": {"snaktype": "value", "datatype": "commonsMedia", "datavalue": {"value": "File:Bild_%d a.jpg"}}}], "P2": "leer"}""",
        F.col("c_custkey") % 90 + 10,
        F.col("c_custkey") % 9 + 1,
        F.col("c_nationkey"),
        F.col("c_custkey"),
        F.col("c_nationkey"),
        F.col("c_custkey"),
    )
    return b.table("customer").select("c_custkey", doc.alias("claims"))


_BORN = "concat('19', lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0'), '-05-0', c_custkey % 9 + 1)"
_FACTS = f"""
SELECT c_custkey, 'P569' AS prop_id, {_BORN} AS value, 'time' AS datatype FROM customer
UNION ALL SELECT c_custkey, 'P27', concat('Q', c_nationkey), 'wikibase-item' FROM customer
UNION ALL SELECT c_custkey, 'P1082', CAST(c_custkey AS VARCHAR), 'quantity' FROM customer
UNION ALL SELECT c_custkey, 'P625', concat('{{"latitude":', c_nationkey, '.5,"longitude":13}}'), 'globe-coordinate' FROM customer
UNION ALL SELECT c_custkey, 'P18', concat('File:Bild_', c_custkey, ' a.jpg'), 'commonsMedia' FROM customer
"""


@query("f35_claims_all", _FACTS)
def _(b):
    rows = C.claims_all(claim_documents(b), ["c_custkey"])
    return rows.drop("pos")


@query("f35_claims_sync", f"SELECT c_custkey, 'P569' AS prop_id, {_BORN} AS value FROM customer")
def _(b):
    return C.claims_sync(claim_documents(b), ["c_custkey"])


@query("f36_claim_coordinates", "SELECT c_custkey, c_nationkey + CAST(0.5 AS DOUBLE) AS lat, CAST(13 AS DOUBLE) AS lon FROM customer")
def _(b):
    return C.claim_coordinates(claim_documents(b), ["c_custkey"])


@query(
    "f36_claim_images",
    f"SELECT c_custkey, concat('Bild ', c_custkey, ' a.jpg') AS value, concat('{C.FILE_URL}Bild_', c_custkey, '_a.jpg?width=200') AS thumb_url, concat('{C.FILE_URL}Bild_', c_custkey, '_a.jpg?width=1024') AS source_url FROM customer",
)
def _(b):
    return C.claim_images(claim_documents(b), ["c_custkey"])


def labels(b):
    """Nation names as German labels for every second nation and as English ones for every third."""
    n = F.col("n_nationkey")
    q = F.concat(F.lit("Q"), n.cast("string")).alias("id")
    nation = b.table("nation")
    return nation.where(n % 2 == 0).select(q, F.lit("de").alias("language"), F.concat(F.lit("Land "), n.cast("string")).alias("label")).unionByName(
        nation.where(n % 3 == 0).select(q, F.lit("en").alias("language"), F.col("n_name").alias("label"))
    )


_LABEL = "CASE WHEN c_nationkey % 2 = 0 THEN concat('Land ', c_nationkey) WHEN c_nationkey % 3 = 0 THEN n_name END"


@query(
    "x15_resolve_labels",
    f"SELECT DISTINCT concat('Q', c_nationkey) AS id, coalesce({_LABEL}, concat('Q', c_nationkey)) AS label FROM customer JOIN nation ON n_nationkey = c_nationkey",
)
def _(b):
    ids = b.table("customer").select(F.concat(F.lit("Q"), F.col("c_nationkey").cast("string")).alias("id"))
    return C.resolve_labels(ids, labels(b)).drop("known")


@query(
    "x16_labelled_claims",
    f"""SELECT f.c_custkey, f.prop_id, f.value, CASE f.prop_id WHEN 'P569' THEN 'Geburtsdatum' WHEN 'P27' THEN 'Staatsangehörigkeit' WHEN 'P18' THEN 'Bild' ELSE f.prop_id END AS label,
      CASE WHEN f.prop_id = 'P27' THEN 'entity' ELSE 'literal' END AS value_type, CASE WHEN f.prop_id = 'P27' THEN {_LABEL} END AS value_label, CASE WHEN f.prop_id = 'P27' THEN concat('{C.ENTITY_PAGE}', f.value) END AS value_url
    FROM ({_FACTS}) f JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey""",
)
def _(b):
    rows = C.claims_all(claim_documents(b), ["c_custkey"])
    return C.labelled_claims(rows, labels(b)).drop("pos", "datatype")


@query(
    "m22_sync_claims",
    f"SELECT f.c_custkey, f.prop_id, f.value, CASE WHEN f.prop_id = 'P27' THEN {_LABEL} END AS value_label FROM ({_FACTS}) f JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey WHERE f.prop_id IN ('P27', 'P569')",
)
def _(b):
    return C.claims_to_store(claim_documents(b), ["c_custkey"], labels(b), selected_properties=["P27", "P569"])


@query(
    "m22_sync_claims_properties",
    f"SELECT c_custkey, 'P569' AS prop_id, {_BORN} AS value, CAST(NULL AS VARCHAR) AS value_label FROM customer",
)
def _(b):
    return C.claims_to_store(claim_documents(b), ["c_custkey"], labels(b))


@query(
    "m22_sync_claims_selected",
    f"""SELECT c_custkey, 'P27' AS prop_id, concat('Q', c_nationkey) AS value, {_LABEL} AS value_label FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey, 'P106', c_mktsegment, NULL FROM customer""",
)
def _(b):
    who = b.table("customer")
    nation = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" Q"), F.col("c_nationkey").cast("string")))
    chosen = who.select("c_custkey", F.lit("P27").alias("prop_id"), nation.alias("value")).unionByName(
        who.select("c_custkey", F.lit("P106").alias("prop_id"), F.col("c_mktsegment").alias("value"))
    )
    return C.claims_to_store(claim_documents(b), ["c_custkey"], labels(b), selected_claims=chosen)


@query(
    "f38_property_label",
    f"SELECT c_custkey, prop_id, CASE prop_id WHEN 'P569' THEN 'Geburtsdatum' WHEN 'P27' THEN 'Staatsangehörigkeit' WHEN 'P18' THEN 'Bild' ELSE prop_id END AS label FROM ({_FACTS})",
)
def _(b):
    rows = C.claims_all(claim_documents(b), ["c_custkey"])
    return rows.select("c_custkey", "prop_id", C.property_label(F.col("prop_id")).alias("label"))


# --- streams ------------------------------------------------------------------------------


def _job_stream(b):
    """The event file as a stream, seen as jobs."""
    path = f"{b.sf_dir}/events.parquet"
    schema: StructType = b.spark.read.parquet(path).schema
    events = b.spark.readStream.schema(schema).parquet(f"{b.sf_dir}/events*.parquet")
    return b.spark.sql(A_JOB.replace("FROM events", "FROM {events}"), events=events)


def _drain(b, df, name: str):
    """Run a stream over what is there, into a table in the shared folder, and read it back."""
    folder = shared_folder(b.spark, name)
    run = (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return b.spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("r2_stream_job_dedupe", "SELECT DISTINCT page_id, job_type FROM a_job")
def _(b):
    return _drain(b, stream.dedupe_job_requests(_job_stream(b)), "dedupe").select("page_id", "job_type")


@query(
    "r2_stream_job_bursts",
    """WITH g AS (SELECT *, coalesce(created_at - lag(created_at) OVER w > INTERVAL 1 HOUR, true) AS new FROM a_job WINDOW w AS (PARTITION BY page_id, job_type ORDER BY created_at)),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY page_id, job_type ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT page_id, job_type, epoch_us(min(created_at)) // 1000000 AS requested_s, count(*) AS requests FROM s GROUP BY page_id, job_type, k
    HAVING max(created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM a_job) - INTERVAL 1 HOUR""",
)
def _(b):
    rows = _drain(b, stream.job_request_bursts(_job_stream(b)), "bursts")
    return rows.select("page_id", "job_type", F.unix_timestamp("requested_at").alias("requested_s"), "requests")


@query(
    "r3_stream_job_throughput",
    """SELECT epoch(w)::BIGINT AS window_start, job_type, status, count(*) AS jobs, round(sum(wait_s), 4) AS wait_s FROM (SELECT *, date_trunc('hour', created_at) AS w FROM a_job)
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM a_job) - INTERVAL 1 HOUR GROUP BY ALL""",
)
def _(b):
    rows = _drain(b, stream.job_throughput(_job_stream(b)), "throughput")
    return rows.select(
        F.unix_timestamp("window_start").alias("window_start"), "job_type", "status", "jobs", F.round("wait_s", 4).alias("wait_s")
    )


@query(
    "r1_stream_metric_refresh",
    f"""SELECT page_id, d.median_density, r.reviewed_pct, CAST(n AS BIGINT) AS char_count FROM ({S.DENSITY}) d JOIN ({S.REVIEWED}) r USING (page_id)
    JOIN (SELECT page_id, sum(n) AS n FROM a_box GROUP BY page_id) USING (page_id) WHERE page_id % 3 = 0""",
)
def _(b):
    folder = shared_folder(b.spark, "metrics")
    boxes = b.a_box.withColumn("metrics_stale", F.col("page_id") % 3 == 0)
    stream.write_boxes(boxes, f"{folder}/boxes")
    changed = b.spark.readStream.schema(boxes.schema).parquet(f"{folder}/boxes")
    run = stream.metric_refresh(
        changed.select("page_id", "box_index", "metrics_stale"), f"{folder}/boxes", f"{folder}/rows", f"{folder}/state", S.WIDTH
    )
    run.trigger(availableNow=True).start().awaitTermination()
    rows = stream.current_metrics(b.spark.read.parquet(f"{folder}/rows"))
    return rows.select("page_id", "median_density", "reviewed_pct", "char_count")

