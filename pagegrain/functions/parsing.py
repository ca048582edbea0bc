"""Column functions that read times, confidences and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import text as T
from pagegrain.functions.scores import unit_range

# Words for confidence, and the roles people can have in a unit.
HIGH = ("hoch", "high", "gut", "good", "sehr gut", "sehr hoch")
MIDDLE = ("mittel", "medium", "mäßig")
LOW = ("niedrig", "low", "unsicher")
ROLES = (
    "Clubvorstand",
    "anwesendes Clubmitglied",
    "abwesendes Clubmitglied",
    "Referent",
    "rotarischer Gast",
    "nicht-rotarischer Gast",
    "andere",
)


def parse_iso(c: Column) -> Column:
    """ISO time, ``Z`` allowed; anything else gives null."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(F.rlike(c, F.lit(shape)), c.try_cast("timestamp"))


def parse_confidence(c: Column) -> Column:
    """number or percentage clamped to 0..1, a word, else 0.5."""
    s = F.lower(T.strip(c))
    percent = F.when(F.contains(s, F.lit("%")), T.strip(F.replace(s, F.lit("%"), F.lit(""))).try_cast("double"))
    return (
        F.when(s.isNull() | (s == ""), 0.5)
        .when(percent.isNotNull(), unit_range(percent / 100.0))
        .when(s.try_cast("double").isNotNull(), unit_range(s.try_cast("double")))
        .when(s.isin(*HIGH), 0.9)
        .when(s.isin(*MIDDLE), 0.6)
        .when(s.isin(*LOW), 0.3)
        .otherwise(0.5)
    )


def _truth(v: Column) -> Column:
    """Truth of a JSON value: false, 0, '' and null are false."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | F.is_variant_null(v), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(text.try_cast("double").isNotNull(), text.try_cast("double") != 0)
        .otherwise(True)
    )


def _answer(c: Column) -> Column:
    """A JSON object as a variant, else null."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def parse_review_json(df: DataFrame, answer: str) -> DataFrame:
    """F32: add corrected_text, confidence, auto_confirm and reason of a model answer.

    Tried in turn: the whole answer, its first line, a fenced block, the
    outermost braces; the first that has corrected_text counts.  All four
    columns are null when none does.
    """
    t = T.strip(answer)
    tries = [
        t,
        F.split_part(t, F.lit("\n"), F.lit(1)),
        T.strip(F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)),
        F.regexp_extract(t, r"(\{[\s\S]*\})", 1),
    ]

    def usable(raw: Column) -> Column:
        has_text = lambda v: F.try_variant_get(v, "$.corrected_text", "string").isNotNull()
        return F.get(F.filter(F.array(F.try_parse_json(raw)), has_text), F.lit(0))

    # coalesce stops at the first usable try, so the later ones are rarely parsed
    d = df.withColumn("_v", F.coalesce(*[usable(x) for x in tries]))
    ok = F.col("_v").isNotNull()
    flag = F.try_variant_get("_v", "$.auto_confirm", "variant")
    return d.withColumns(
        {
            "corrected_text": F.when(ok, T.strip(F.try_variant_get("_v", "$.corrected_text", "string"))),
            "confidence": F.when(ok, parse_confidence(F.try_variant_get("_v", "$.confidence", "string"))),
            "auto_confirm": F.when(ok, _truth(flag)),
            "reason": F.when(ok, F.coalesce(T.strip(F.try_variant_get("_v", "$.reason", "string")), F.lit(""))),
        }
    ).drop("_v")


def first_object(c: Column) -> Column:
    """Text from the first opening brace to the brace that closes it, else null."""
    start = F.instr(c, "{")
    chars = T.characters(F.substr(c, start))
    ends = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")),
        lambda s, ch: F.struct(
            (
                s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
            ).alias("depth"),
            (s["at"] + 1).alias("at"),
            F.when(s["end"] > 0, s["end"])
            .when((ch == "}") & (s["depth"] == 1), s["at"] + 1)
            .otherwise(0)
            .alias("end"),
        ),
        lambda s: s["end"],
    )
    return F.when((start > 0) & (ends > 0), F.substr(c, start, ends))


def parse_unit_json(df: DataFrame, answer: str) -> DataFrame:
    """add the fields of a content answer; all are null when it holds no JSON object.

    Texts are trimmed or null, lists default to empty, people need a name, and
    an unknown role becomes ``andere``.
    """
    t = T.strip(answer)
    fenced = F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)
    body = F.when(F.rlike(t, F.lit(r"```(?:json)?\s*[\s\S]*?```")), T.strip(fenced)).otherwise(t)
    d = df.withColumn("_body", body).withColumn("_v", _answer(first_object(F.col("_body"))))
    v, ok = F.col("_v"), F.col("_v").isNotNull()

    def text(name: str) -> Column:
        return F.nullif(T.strip(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))

    def items(name: str) -> Column:
        got = F.try_variant_get(v, f"$.{name}", "array<variant>")
        return F.coalesce(got, F.array().cast("array<variant>"))

    role = lambda p: F.coalesce(T.strip(F.try_variant_get(p, "$.role", "string")), F.lit(""))
    name = lambda p: F.coalesce(F.try_variant_get(p, "$.name", "string"), F.lit(""))
    people = F.transform(
        F.filter(items("persons"), lambda p: name(p) != ""),
        lambda p: F.struct(
            T.strip(name(p)).alias("name"),
            F.when(role(p).isin(*ROLES), role(p)).otherwise("andere").alias("role"),
        ),
    )
    strings = {
        n: F.when(ok, F.filter(F.transform(items(n), lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull()))
        for n in ("extracted_phrases", "extracted_names")
    }
    return d.withColumns(
        {
            "belongs_with_next": F.when(ok, _truth(F.try_variant_get(v, "$.belongs_with_next", "variant"))),
            **{n: F.when(ok, text(n)) for n in ("summary", "topic", "place", "event_date")},
            "persons": F.when(ok, people),
            **strings,
        }
    ).drop("_v", "_body")
