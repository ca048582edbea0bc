"""Operators on the triple table ``triples(subject, predicate, object, object_type)``.

A statement is a node with statementSubject, statementPredicate,
statementObject and any number of sources (belegtIn).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import claims as C
from pagegrain.functions import text as T

TRIPLE = ["subject", "predicate", "object", "object_type"]
UNIT_SEP = "\x1f"

# Predicates of places, and relations shown on the place map.
PLACE_FIELDS = {
    "name": "name",
    "sameAs": "wikidata",
    "mainImage": "main_image_url",
    "lat": "lat",
    "lon": "lon",
    "historicalAddress": "historical_address",
    "adressbuchUrl": "adressbuch_url",
    "adressbuchPage": "adressbuch_page",
}
RELATIONS = {"P551": "residence", "P937": "work", "P276": "event"}
PERSON_RELATIONS = ("residence", "work")
LINK_TARGETS = {"P551": "Person_", "P937": "Person_", "P276": "Event_"}


def add_triples(triples: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union as a set; a missing object type means uri.

    The stored ``triples`` are a set already, so only fresh rows are deduplicated: those that are stored too are
    found from the stored side, which Spark needn't shuffle while the fresh rows are few.
    """
    ready = fresh if "object_type" in fresh.columns else fresh.withColumn("object_type", F.lit(None).cast("string"))
    ready = ready.withColumn("object_type", F.coalesce("object_type", F.lit("uri"))).select(*TRIPLE)
    stored = triples.select(*TRIPLE)
    wanted = ready.toDF(*[f"_{c}" for c in TRIPLE])
    same = F.lit(True)
    for c in TRIPLE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.unionByName(ready.subtract(stored.join(wanted, same, "left_semi")))


def statements(triples: DataFrame) -> DataFrame:
    """Statement nodes with subject, predicate, object and one row per source (or a null source).

    The three parts of a node come from one aggregate; a node with several values of a part gives all combinations.
    Sources are joined, as a statement may have any number of them.
    """
    pred = F.col("predicate")
    parts = {"subject": "statementSubject", "predicate": "statementPredicate", "object": "statementObject"}
    node = triples.where(pred.isin(*parts.values())).groupBy(F.col("subject").alias("statement")).agg(
        *[F.collect_set(F.when(pred == p, F.col("object"))).alias(f"_{c}") for c, p in parts.items()]
    )
    for c in parts:
        node = node.withColumn(c, F.explode(f"_{c}"))
    sources = triples.where(pred == "belegtIn").select(
        F.col("subject").alias("statement"), F.col("object").alias("source")
    )
    return node.select("statement", *parts).join(sources, "statement", "left")


def statements_by_subject(triples: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Statements of the given subjects (``subjects.subject``), or of all."""
    s = statements(triples)
    return s if subjects is None else s.join(subjects.select("subject").distinct(), "subject", "left_semi")


def statements_by_object(triples: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Statements about the given objects (``objects.object``), or about all."""
    s = statements(triples)
    return s if objects is None else s.join(objects.select("object").distinct(), "object", "left_semi")


def statement_by_source(triples: DataFrame) -> DataFrame:
    """The first statement (least node) attached to each source."""
    s = statements(triples).where(F.col("source").isNotNull())
    return s.groupBy("source").agg(F.min(F.struct("statement", "subject", "predicate", "object")).alias("_s")).select(
        "source", "_s.*"
    )


def _text(c: Column) -> Column:
    return F.nullif(T.strip(c), F.lit(""))


def _entity_id(uri: Column) -> Column:
    tail = F.substring_index(uri, "entity/", -1)
    short = F.substring_index(F.substring_index(tail, "/", 1), "#", 1)
    return F.when(F.contains(uri, F.lit("wikidata.org/entity/")), short)


def entity_details(triples: DataFrame, kind: str | None = None) -> DataFrame:
    """X5 and the head of X6: one row per named entity; of several values the least is taken."""
    t = triples.where(F.col("predicate").isin(*PLACE_FIELDS))
    if kind is not None:
        t = t.where(T.entity_kind("subject") == kind)
    wide = t.groupBy("subject").agg(
        *[F.min(F.when(F.col("predicate") == p, F.col("object"))).alias(n) for p, n in PLACE_FIELDS.items()]
    )
    return wide.where(F.col("name").isNotNull()).select(
        F.col("subject").alias("entity_uri"),
        T.strip("name").alias("name"),
        _entity_id(F.col("wikidata")).alias("wikidata_id"),
        _text(F.col("main_image_url")).alias("main_image_url"),
        F.expr("try_cast(lat AS DOUBLE)").alias("lat"),
        F.expr("try_cast(lon AS DOUBLE)").alias("lon"),
        *[_text(F.col(c)).alias(c) for c in ("historical_address", "adressbuch_url", "adressbuch_page")],
    )


def place_details(triples: DataFrame) -> DataFrame:
    """Places with id, image, coordinates and address."""
    return entity_details(triples, "place")


def person_details(triples: DataFrame) -> DataFrame:
    """People with authority id and image."""
    return entity_details(triples, "person").select("entity_uri", "name", "wikidata_id", "main_image_url")


def entity_claims(triples: DataFrame) -> DataFrame:
    """Claim values of every entity, one row each, entity values shortened to their id.

    Labels come from ``prop/value/label`` literals; the older label predicate
    of a property is the fallback for all of its values.
    """
    claim = triples.where(F.col("predicate").startswith(C.CLAIM)).select(
        F.col("subject").alias("entity_uri"),
        F.replace("predicate", F.lit(C.CLAIM), F.lit("")).alias("prop_id"),
        F.coalesce(_entity_id(F.col("object")), T.strip("object")).alias("value"),
    )
    claim = claim.where((F.col("prop_id") != "") & (F.col("value") != "")).distinct()
    part = F.split("object", UNIT_SEP, 3)
    new = (
        triples.where((F.col("predicate") == "claimValueLabel") & (F.size(part) >= 3))
        .select(
            F.col("subject").alias("entity_uri"),
            T.strip(part[0]).alias("prop_id"),
            T.strip(part[1]).alias("value"),
            T.strip(part[2]).alias("_new"),
        )
        .groupBy("entity_uri", "prop_id", "value")
        .agg(F.min("_new").alias("_new"))
    )
    old = (
        triples.where(F.col("predicate").startswith("claimValueLabel_"))
        .select(
            F.col("subject").alias("entity_uri"),
            F.substr("predicate", F.lit(len("claimValueLabel_") + 1)).alias("prop_id"),
            _text(F.col("object")).alias("_old"),
        )
        .groupBy("entity_uri", "prop_id")
        .agg(F.min("_old").alias("_old"))
    )
    return (
        claim.join(new, ["entity_uri", "prop_id", "value"], "left")
        .join(old, ["entity_uri", "prop_id"], "left")
        .select("entity_uri", "prop_id", "value", F.coalesce("_new", "_old").alias("label"))
    )


def entity_preview(triples: DataFrame, most: int = 20) -> DataFrame:
    """Name, kind, image and up to ``most`` claims per entity, one row per claim.

    An entity without claims has one row with null property and value.
    """
    w = Window.partitionBy("entity_uri").orderBy("prop_id", "value")
    few = (
        entity_claims(triples)
        .select("entity_uri", "prop_id", "value")
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= most)
        .drop("_rn")
    )
    head = entity_details(triples).select(
        "entity_uri", "name", T.entity_kind("entity_uri").alias("kind"), "wikidata_id", "main_image_url"
    )
    return head.join(few, "entity_uri", "left")


def find_by_name(names: DataFrame, triples: DataFrame) -> DataFrame:
    """Entity with exactly the (trimmed) name, per ``names(name, kind)``; the least URI of several.

    Places and events need a URI of their kind; a person may be any entity.
    """
    known = triples.where(F.col("predicate") == "name").select(
        F.col("object").alias("_name"), F.col("subject").alias("_uri")
    )
    n = names.select("name", "kind").distinct().withColumn("_name", T.strip("name")).where(F.col("_name") != "")
    fits = (F.col("kind") == "person") | (T.entity_kind("_uri") == F.col("kind"))
    return n.join(known, "_name").where(fits).groupBy("name", "kind").agg(F.min("_uri").alias("entity_uri"))


def suggest_entities(triples: DataFrame, term: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Entities whose name contains the term, by name; at most 1..50 of them."""
    term = term.strip().lower()
    named = triples.where(
        (F.col("predicate") == "name") & F.contains(F.lower("object"), F.lit(term)) & F.lit(term != "")
    )
    if kind is not None:
        prefix = {"person": "Person_", "place": "Place_", "event": "Event_"}[kind]
        named = named.where(T.local_id("subject").startswith(prefix))
    return (
        named.select(F.col("subject").alias("uri"), F.col("object").alias("name"))
        .orderBy("name", "uri")
        .limit(max(1, min(limit, 50)))
    )


def list_triples(
    triples: DataFrame, subject: str | None = None, predicate: str | None = None, limit: int = 100
) -> DataFrame:
    """Triples of a subject or predicate; the object type is read off the object."""
    t = triples
    if subject is not None:
        t = t.where(F.col("subject") == subject)
    if predicate is not None:
        t = t.where(F.col("predicate") == predicate)
    kind = F.when(F.col("object").startswith("http"), "uri").otherwise("literal")
    return t.orderBy("subject", "predicate", "object").limit(limit).select("subject", "predicate", "object", kind.alias("object_type"))


def document_entities(triples: DataFrame) -> DataFrame:
    """Entities with type that each document mentions.

    Both sides are deduplicated before the join: repeated mentions of an entity don't meet its repeated types.
    """
    said = triples.where(F.col("predicate") == "erwaehnt").select(
        F.col("subject").alias("document"), F.col("object").alias("entity")
    )
    typed = triples.where(F.col("predicate") == "entityType").select(
        F.col("subject").alias("entity"), F.col("object").alias("type")
    )
    return said.distinct().join(typed.distinct(), "entity")


def entity_documents(triples: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Documents that mention an entity."""
    said = triples.where(F.col("predicate") == "erwaehnt").select(
        F.col("object").alias("entity"), F.col("subject").alias("document")
    )
    said = said if entities is None else said.join(entities.select("entity"), "entity", "left_semi")
    return said.distinct()


# --- place map -----------------------------------------------------------------------


def place_map(mentions: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places with coordinates, and the rows linked to each of them.

    The second table has ``item`` page (value = page id), relation (value =
    relation type) or person (value = person URI, label = name, relation).
    """
    places = place_details(triples).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    seen = mentions.where(F.contains(F.coalesce("entity_uri", F.lit("")), F.lit("Place_")))
    shown = places.join(seen.select("entity_uri"), "entity_uri", "left_semi")
    uri = shown.select(F.col("entity_uri").alias("place_uri"))
    pages = seen.select(F.col("entity_uri").alias("place_uri"), "page_id").distinct()
    relation = F.element_at(
        F.create_map(*[F.lit(v) for kv in RELATIONS.items() for v in kv]), T.local_id("predicate")
    )
    linked = (
        statements(triples)
        .select(F.col("object").alias("place_uri"), "subject", relation.alias("relation"))
        .where(F.col("relation").isNotNull())
        .distinct()
    )
    none = F.lit(None).cast("string")
    people = linked.where(
        F.col("relation").isin(*PERSON_RELATIONS) & F.contains(F.col("subject"), F.lit("Person_"))
    ).join(person_details(triples).select(F.col("entity_uri").alias("subject"), "name"), "subject", "left")
    rows = (
        pages.select("place_uri", F.lit("page").alias("item"), F.col("page_id").cast("string").alias("value"), none.alias("label"), none.alias("relation"))
        .unionByName(
            linked.select("place_uri", F.lit("relation").alias("item"), F.col("relation").alias("value"), none.alias("label"), "relation").distinct()
        )
        .unionByName(
            people.select(
                "place_uri",
                F.lit("person").alias("item"),
                F.col("subject").alias("value"),
                F.coalesce(F.nullif("name", F.lit("")), T.local_id("subject")).alias("label"),
                "relation",
            )
        )
    )
    return shown.withColumn("place_id", T.local_id("entity_uri")), rows.join(uri, "place_uri", "left_semi")


# --- edits ----------------------------------------------------------------------------


def _rows(df: DataFrame, parts: Sequence[tuple[Column, str, Column, str]]) -> DataFrame:
    """Triples from columns; a row whose object is null or blank vanishes."""
    made = F.array(
        *[
            F.struct(
                s.cast("string").alias("subject"),
                F.lit(p).alias("predicate"),
                o.cast("string").alias("object"),
                F.lit(kind).alias("object_type"),
            )
            for s, p, o, kind in parts
        ]
    )
    return df.select(F.explode(made).alias("_t")).select("_t.*").where(T.strip(F.coalesce("object", F.lit(""))) != "")


def claim_triples(claims: DataFrame) -> DataFrame:
    """Triples of ``claims(entity_uri, prop_id, value, value_label)``; ids become entity URIs."""
    value = T.strip("value")
    entity = C.is_entity_id(F.col("value"))
    kept = claims.where(F.coalesce(value, F.lit("")) != "")
    facts = kept.select(
        F.col("entity_uri").alias("subject"),
        F.concat(F.lit(C.CLAIM), F.col("prop_id")).alias("predicate"),
        F.when(entity, F.concat(F.lit(C.ENTITY), value)).otherwise(value).alias("object"),
        F.when(entity, "uri").otherwise("literal").alias("object_type"),
    )
    labels = kept.where(T.strip(F.coalesce("value_label", F.lit(""))) != "").select(
        F.col("entity_uri").alias("subject"),
        F.lit("claimValueLabel").alias("predicate"),
        F.concat_ws(UNIT_SEP, "prop_id", value, T.strip("value_label")).alias("object"),
        F.lit("literal").alias("object_type"),
    )
    return facts.unionByName(labels)


def upsert_person(triples: DataFrame, people: DataFrame, claims: DataFrame) -> DataFrame:
    """Replace names, claims and labels of ``people(entity_uri, name, wikidata_id,
    main_image_url, update_main_image)``.

    The authority link changes only when an id is given, the image only when flagged. Of several rows of one
    entity all must replace a field for its old values to go; their new values all stay.
    """
    p = people.groupBy(F.col("entity_uri").alias("subject")).agg(
        F.bool_and(F.col("wikidata_id").isNotNull()).alias("_id"),
        F.bool_and(F.coalesce("update_main_image", F.lit(False))).alias("_img"),
    )
    pred = F.col("predicate")
    goes = F.col("_img").isNotNull() & (
        (pred == "name")
        | ((pred == "sameAs") & F.col("_id"))
        | pred.startswith(C.CLAIM)
        | (pred == "claimValueLabel")
        | pred.startswith("claimValueLabel_")
        | ((pred == "mainImage") & F.col("_img"))
    )
    kept = triples.join(p, "subject", "left").where(~F.coalesce(goes, F.lit(False))).select(*TRIPLE)
    uri = F.col("entity_uri")
    fresh = _rows(
        people,
        [
            (uri, "name", F.col("name"), "literal"),
            (uri, "sameAs", F.concat(F.lit(C.ENTITY), F.col("wikidata_id")), "uri"),
            (uri, "mainImage", F.when(F.col("update_main_image"), T.strip("main_image_url")), "literal"),
        ],
    )
    return add_triples(kept, fresh.unionByName(claim_triples(claims)))


def upsert_place(triples: DataFrame, places: DataFrame) -> DataFrame:
    """Replace all place fields of ``places(entity_uri, name, wikidata_id, main_image_url,
    update_main_image, lat, lon, historical_address, adressbuch_url, adressbuch_page)``.

    Fields that are not given are lost, but an old image stays unless a new one
    is given with the flag (in all rows, if an entity has several).
    """
    image = F.coalesce("update_main_image", F.lit(False)) & (T.strip(F.coalesce("main_image_url", F.lit(""))) != "")
    p = places.groupBy(F.col("entity_uri").alias("subject")).agg(F.bool_and(image).alias("_img"))
    pred = F.col("predicate")
    goes = F.col("_img").isNotNull() & pred.isin(*PLACE_FIELDS) & ((pred != "mainImage") | F.col("_img"))
    kept = triples.join(p, "subject", "left").where(~F.coalesce(goes, F.lit(False))).select(*TRIPLE)
    uri = F.col("entity_uri")
    literal = [(uri, k, F.col(v), "literal") for k, v in PLACE_FIELDS.items() if k not in ("sameAs", "mainImage")]
    fresh = _rows(
        places,
        [
            *literal,
            (uri, "sameAs", F.concat(F.lit(C.ENTITY), F.col("wikidata_id")), "uri"),
            (uri, "mainImage", F.when(F.col("update_main_image"), T.strip("main_image_url")), "literal"),
        ],
    )
    return add_triples(kept, fresh)


def remove_statements(triples: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop every triple of the nodes attached to a source (``sources.source``)."""
    nodes = triples.where(F.col("predicate") == "belegtIn").join(
        sources.select(F.col("source").alias("object")).distinct(), "object", "left_semi"
    )
    return triples.join(nodes.select("subject"), "subject", "left_anti").select(*TRIPLE)


def removed_statements(triples: DataFrame, sources: DataFrame) -> DataFrame:
    """How many triples the removal drops."""
    kept = remove_statements(triples, sources).agg(F.count(F.lit(1))).scalar()
    return triples.agg((F.count(F.lit(1)) - kept).alias("removed"))


def mention_triples(mentions: DataFrame) -> DataFrame:
    """Triples of ``(mention_uri, entity_uri, source_uri, role)``."""
    m = F.col("mention_uri")
    return _rows(
        mentions,
        [
            (m, "beziehtSichAuf", F.col("entity_uri"), "uri"),
            (m, "belegtIn", F.col("source_uri"), "uri"),
            (m, "rolle", F.col("role"), "literal"),
        ],
    )


def source_triples(rows: DataFrame) -> DataFrame:
    """Triples of source nodes ``(node_uri, source_uri, subject, predicate, object)``."""
    n = F.col("node_uri")
    return _rows(
        rows,
        [
            (n, "belegtIn", F.col("source_uri"), "uri"),
            (n, "aussageSubjekt", F.col("subject"), "uri"),
            (n, "aussagePraedikat", F.col("predicate"), "uri"),
            (n, "aussageObjekt", F.col("object"), "uri"),
        ],
    )


def statement_triples(rows: DataFrame) -> DataFrame:
    """Triples of ``(statement_uri, subject, predicate, object, source_uri, page_uri)``."""
    s = F.col("statement_uri")
    return _rows(
        rows,
        [
            (s, "statementSubject", F.col("subject"), "uri"),
            (s, "statementPredicate", F.col("predicate"), "uri"),
            (s, "statementObject", F.col("object"), "uri"),
            (s, "belegtIn", F.col("source_uri"), "uri"),
            (s, "belegtIn", F.col("page_uri"), "uri"),
        ],
    )


def entity_triples(rows: DataFrame) -> DataFrame:
    """Triples of new people, events or clubs ``(entity_uri, name, wikidata_id, main_image_url)``."""
    uri = F.col("entity_uri")
    return _rows(
        rows,
        [
            (uri, "name", F.col("name"), "literal"),
            (uri, "sameAs", F.concat(F.lit(C.ENTITY), F.col("wikidata_id")), "uri"),
            (uri, "mainImage", T.strip("main_image_url"), "literal"),
        ],
    )


def place_links(links: DataFrame) -> DataFrame:
    """Statements that tie a person or event to a place; inadmissible pairs are dropped.

    ``links(subject, property_id, place_uri, source_uri, page_uri)``: residence
    and work need a person, the venue an event.
    """
    target = F.element_at(F.create_map(*[F.lit(v) for kv in LINK_TARGETS.items() for v in kv]), F.col("property_id"))
    return links.where(F.contains(F.col("subject"), target)).select(
        F.concat(
            F.lit("Statement_"), F.sha2(F.concat_ws("|", "subject", "property_id", "place_uri", "source_uri"), 256)
        ).alias("statement_uri"),
        "subject",
        F.concat(F.lit(C.CLAIM), F.col("property_id")).alias("predicate"),
        F.col("place_uri").alias("object"),
        "source_uri",
        "page_uri",
    )


def resolve_mentions(boxes: DataFrame, triples: DataFrame) -> DataFrame:
    """Entity of each mention box ``(id, kind, name)``: existing by name, else a new one.

    A new entity's URI follows from kind and name, so equal names meet.
    """
    known = find_by_name(boxes, triples)
    prefix = F.initcap("kind")
    made = F.concat(prefix, F.lit("_"), F.sha2(F.concat_ws("|", "kind", T.strip("name")), 256))
    return boxes.where(T.strip(F.coalesce("name", F.lit(""))) != "").join(known, ["name", "kind"], "left").select(
        "id",
        "kind",
        "name",
        F.coalesce("entity_uri", made).alias("entity_uri"),
        F.col("entity_uri").isNull().alias("is_new"),
        F.concat(F.lit("Mention_"), F.col("id").cast("string")).alias("mention_uri"),
        F.concat(F.lit("Box_"), F.col("id").cast("string")).alias("source_uri"),
        F.lit(None).cast("string").alias("role"),
    )


# --- authority matching -----------------------------------------------------------------

# Description keywords per entity kind.
KEYWORDS = {
    "person": ("person", "mensch", "politiker", "schriftsteller"),
    "place": ("stadt", "ort", "stadtteil", "place"),
    "organisation": ("organisation", "verein", "club", "gesellschaft"),
}


def match_score(name: Column, label: Column, description: Column, context: Column, kind: Column) -> Column:
    """X11: score of a candidate: label match, context in the description, kind keyword; at most 1."""
    n, lab, d = F.lower(name), F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    by_label = F.when(n == lab, 0.5).when(F.contains(lab, n) | F.contains(n, lab), 0.3).otherwise(0.0)
    by_context = F.when((F.coalesce(context, F.lit("")) != "") & F.contains(d, F.lower(context)), 0.2).otherwise(0.0)
    keyword = None
    for k, words in KEYWORDS.items():
        any_word = None
        for w in words:
            any_word = F.contains(d, F.lit(w)) if any_word is None else any_word | F.contains(d, F.lit(w))
        hit = (kind == k) & any_word
        keyword = hit if keyword is None else keyword | hit
    return F.least(F.lit(1.0), by_label + by_context + F.when(keyword, 0.1).otherwise(0.0))
