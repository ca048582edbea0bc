"""Claims of an authority file: values, labels, coordinates and images.

A claims document is a JSON object from property id to a list of statements;
it is read as a variant, so any property set works without a fixed schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T

# Address of media files, name spaces, synchronised properties, labels.
FILE_URL = "https://commons.wikimedia.org/wiki/Special:FilePath/"
ENTITY = "http://www.wikidata.org/entity/"
CLAIM = "http://www.wikidata.org/prop/direct/"
ENTITY_PAGE = "https://www.wikidata.org/wiki/"
SYNC_PROPERTIES = ("P569", "P570")
COORDINATES = "P625"
IMAGE = "P18"
PROPERTY_LABELS = {
    "P569": "Geburtsdatum",
    "P570": "Sterbedatum",
    "P27": "Staatsangehörigkeit",
    "P106": "Beruf",
    "P18": "Bild",
    "P21": "Geschlecht",
    "P19": "Geburtsort",
    "P20": "Sterbeort",
    "P22": "Vater",
    "P25": "Mutter",
}


def media_name(value: Column) -> Column:
    """key of a media file: without ``File:``, underscores as spaces."""
    v = T.strip(value)
    v = F.when(v.startswith("File:"), T.strip(F.substr(v, F.lit(6)))).otherwise(v)
    return F.replace(v, F.lit("_"), F.lit(" "))


def media_url(value: Column, width: int | None = None) -> Column:
    """percent-encoded address of a media file, optionally of one width."""
    # url_encode follows form encoding; put back what a path segment keeps
    name = F.url_encode(F.replace(media_name(value), F.lit(" "), F.lit("_")))
    for code, char in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        name = F.replace(name, F.lit(code), F.lit(char))
    url = F.concat(F.lit(FILE_URL), name)
    return url if width is None else F.concat(url, F.lit(f"?width={width}"))


def claim_date(value: Column) -> Column:
    """leading date of a time value, a plus sign dropped; else null."""
    found = F.regexp_extract(T.strip(value), r"^([+-]?\d{4}-\d{2}-\d{2})", 1)
    return F.nullif(F.regexp_replace(found, r"^\+", ""), F.lit(""))


def property_label(prop: Column) -> Column:
    """label of a property, else its id."""
    table = F.create_map(*[F.lit(v) for kv in PROPERTY_LABELS.items() for v in kv])
    return F.coalesce(F.element_at(table, prop), prop)


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("_st"), path, kind)


def statements(df: DataFrame, keys: Sequence[str], claims: str = "claims") -> DataFrame:
    """One row per usable statement: keys, prop_id, pos and its raw parts."""
    doc = F.try_variant_get(F.try_parse_json(claims), "$", "map<string,variant>")
    per_prop = df.select(*keys, F.explode(doc).alias("prop_id", "_list"))
    return (
        per_prop.select(
            *keys, "prop_id", F.posexplode(F.try_variant_get("_list", "$", "array<variant>")).alias("pos", "_st")
        )
        .where(_field("$.mainsnak.snaktype") == "value")
        .select(
            *keys,
            "prop_id",
            "pos",
            F.coalesce(_field("$.mainsnak.datatype"), F.lit("")).alias("datatype"),
            _field("$.mainsnak.datavalue.value").alias("_raw"),
            *[
                _field(f"$.mainsnak.datavalue.value.{p}").alias(f"_{p}")
                for p in ("time", "amount", "id", "value", "latitude", "longitude")
            ],
        )
    )


def claims_all(df: DataFrame, keys: Sequence[str], claims: str = "claims") -> DataFrame:
    """every usable statement as (prop_id, pos, value, datatype)."""
    is_object = F.col("_raw").startswith("{")
    value = (
        F.when(F.col("_raw").isNull(), F.lit(None))
        .when((F.col("datatype") == "time") & F.col("_time").isNotNull(), claim_date(F.col("_time")))
        .when((F.col("datatype") == "commonsMedia") & is_object & F.col("_value").isNotNull(), F.col("_value"))
        .when(F.col("_amount").isNotNull(), T.strip(F.replace("_amount", F.lit("+"), F.lit(""))))
        .when(F.col("_id").isNotNull(), F.col("_id"))
        .otherwise(F.col("_raw"))
    )
    return (
        statements(df, keys, claims)
        .select(*keys, "prop_id", "pos", value.alias("value"), "datatype")
        .where(F.col("value").isNotNull())
    )


def claims_sync(df: DataFrame, keys: Sequence[str], claims: str = "claims") -> DataFrame:
    """first usable value of each synchronised property."""
    rows = claims_all(df, keys, claims).where(F.col("prop_id").isin(*SYNC_PROPERTIES))
    return rows.groupBy(*keys, "prop_id").agg(F.min_by("value", "pos").alias("value"))


def claim_coordinates(df: DataFrame, keys: Sequence[str], claims: str = "claims") -> DataFrame:
    """first usable coordinate pair of each entity."""
    lat, lon = (F.expr(f"try_cast(_{c} AS DOUBLE)") for c in ("latitude", "longitude"))
    rows = (
        statements(df, keys, claims)
        .where(F.col("prop_id") == COORDINATES)
        .select(*keys, "pos", lat.alias("lat"), lon.alias("lon"))
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )
    return rows.groupBy(*keys).agg(F.min(F.struct("pos", "lat", "lon")).alias("_c")).select(*keys, "_c.lat", "_c.lon")


def claim_images(df: DataFrame, keys: Sequence[str], claims: str = "claims") -> DataFrame:
    """first usable image of each entity with its addresses."""
    name = F.when(F.col("_value").isNotNull(), F.col("_value")).when(~F.col("_raw").startswith("{"), F.col("_raw"))
    rows = (
        statements(df, keys, claims)
        .where(F.col("prop_id") == IMAGE)
        .select(*keys, "pos", name.alias("_n"))
        .where(T.strip(F.coalesce("_n", F.lit(""))) != "")
    )
    first = rows.groupBy(*keys).agg(F.min_by("_n", "pos").alias("_n"))
    return first.select(
        *keys,
        media_name(F.col("_n")).alias("value"),
        media_url(F.col("_n"), 200).alias("thumb_url"),
        media_url(F.col("_n"), 1024).alias("source_url"),
    )


def is_entity_id(value: Column) -> Column:
    return F.rlike(T.strip(value), F.lit(r"^Q\d+$"))


def resolve_labels(ids: DataFrame, labels: DataFrame, language: str = "de") -> DataFrame:
    """Label of each id in the wanted language, else in English, else the id.

    ``ids(id)``, ``labels(id, language, label)``.
    """
    known = labels.where(F.col("language").isin(language, "en")).groupBy("id").agg(
        F.max(F.when(F.col("language") == language, F.col("label"))).alias("_own"),
        F.max(F.when(F.col("language") == "en", F.col("label"))).alias("_en"),
    )
    return ids.select("id").distinct().join(known, "id", "left").select(
        "id", F.coalesce("_own", "_en", "id").alias("label"), F.coalesce("_own", "_en").isNotNull().alias("known")
    )


def labelled_claims(claims: DataFrame, labels: DataFrame, language: str = "de") -> DataFrame:
    """Claim rows with property label, kind, and label and address of entity values."""
    by_language = labels.where(F.col("language").isin(language, "en")).groupBy("id").agg(
        F.coalesce(
            F.max(F.when(F.col("language") == language, F.col("label"))),
            F.max(F.when(F.col("language") == "en", F.col("label"))),
        ).alias("label")
    )
    props = by_language.select(F.col("id").alias("prop_id"), F.col("label").alias("_prop"))
    values = by_language.select(F.col("id").alias("_vid"), F.col("label").alias("value_label"))
    entity = is_entity_id(F.col("value"))
    return (
        claims.withColumn("_vid", F.when(entity, T.strip("value")))
        .join(props, "prop_id", "left")
        .join(values, "_vid", "left")
        .withColumns(
            {
                "label": F.coalesce("_prop", property_label(F.col("prop_id"))),
                "value_type": F.when(entity, "entity").otherwise("literal"),
                "value_url": F.when(entity, F.concat(F.lit(ENTITY_PAGE), F.col("value"))),
            }
        )
        .drop("_prop", "_vid")
    )


def claims_to_store(
    df: DataFrame,
    keys: Sequence[str],
    labels: DataFrame,
    selected_claims: DataFrame | None = None,
    selected_properties: Sequence[str] | None = None,
    claims: str = "claims",
    language: str = "de",
) -> DataFrame:
    """Claims to store per entity, with labels of entity values.

    An explicit selection ``(keys, prop_id, value)`` wins, then a list of
    properties, then the synchronised ones.
    """
    if selected_claims is not None:
        rows = selected_claims.where(F.col("value").isNotNull()).select(*keys, "prop_id", T.strip("value").alias("value"))
    elif selected_properties:
        rows = claims_all(df, keys, claims).where(F.col("prop_id").isin(*selected_properties)).select(*keys, "prop_id", "value")
    else:
        rows = claims_sync(df, keys, claims).select(*keys, "prop_id", T.strip("value").alias("value"))
        rows = rows.where(F.col("value") != "")
    known = resolve_labels(
        rows.where(is_entity_id(F.col("value"))).select(F.col("value").alias("id")), labels, language
    ).where("known")
    return rows.join(known.select(F.col("id").alias("value"), F.col("label").alias("value_label")), "value", "left")
