"""Column functions over recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of the archive's text rules (Unicode
# whitespace, including the ASCII separators 1C-1F), as characters and as the
# inside of a regular expression class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACES = (
    r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Letters that recognisers confuse, each with its other readings.
CONFUSED = {
    "0": "COQ",
    "1": "Il|",
    "5": "S",
    "C": "0GOQ",
    "G": "COQ",
    "I": "1l|",
    "O": "0CGQ",
    "Q": "0CGO",
    "S": "5",
    "a": "o",
    "c": "delo",
    "d": "cl",
    "e": "co",
    "i": "nru",
    "l": "1Icd|",
    "m": "nr",
    "n": "imr",
    "o": "ace",
    "r": "imn",
    "s": "ſ",
    "u": "iv",
    "v": "u",
    "|": "1Il",
    "ſ": "s",
}

# Openings of placeholder texts that are not page text.
REGION_MARK = "[Region - "
IGNORE_MARK = "[Ignore-Bereich]"

PREVIEW_CHARS = 50


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace."""
    return F.btrim(_c(c), F.lit(SPACE_CHARS))


def strip_whitespace(c: Column | str) -> Column:
    """remove every whitespace character."""
    return F.translate(_c(c), SPACE_CHARS, "")


def effective_text(text: Column | str, reviewed: Column | str | None = None) -> Column:
    """Reviewed text if non-empty, else recognised text, else ''."""
    parts = [] if reviewed is None else [F.nullif(_c(reviewed), F.lit(""))]
    return F.coalesce(*parts, _c(text), F.lit(""))


def text_preview(c: Column | str, n: int = PREVIEW_CHARS) -> Column:
    """first ``n`` characters, with ``...`` when the text is longer."""
    c = _c(c)
    head = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(head)


def slug(name: Column | str) -> Column:
    """lower-case URL form of a name; characters outside a-z, 0-9 vanish."""
    s = F.regexp_replace(strip(F.lower(_c(name))), f"[^a-z0-9{SPACES}-]", "")
    return F.btrim(F.regexp_replace(s, f"[{SPACES}-]+", "-"), F.lit("-"))


def hit_position(text: Column | str, term: Column | str) -> Column:
    """1-based position of the first case-insensitive hit, 0 when there is none."""
    return F.position(F.lower(_c(term)), F.lower(_c(text)))


def cut_around(text: Column | str, at: Column, length: Column, window: int) -> Column:
    """``window`` characters on both sides of a hit, with an ellipsis where cut."""
    text = _c(text)
    start = F.greatest(F.lit(0), at - 1 - window)
    end = F.least(F.length(text), at - 1 + length + window)
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(text, start + 1, end - start),
        F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def snippet(
    text: Column | str, term: Column | str, summary: Column | str | None = None, window: int = 120
) -> Column:
    """text around the first hit; no hit gives the summary, else the beginning.

    An empty text gives the summary, or ''.
    """
    text, term = _c(text), _c(term)
    kept = F.lit(None).cast("string") if summary is None else F.nullif(_c(summary), F.lit(""))
    at = hit_position(text, term)
    empty = text.isNull() | (text == "")
    return (
        F.when(empty, F.coalesce(kept, F.lit("")))
        .when(at == 0, F.coalesce(kept, F.substring(text, 1, window * 2)))
        .otherwise(cut_around(text, at, F.length(term), window))
    )


def latin1_text(c: Column | str) -> Column:
    """characters beyond Latin-1 become ``?``."""
    return F.regexp_replace(_c(c), r"[^\u0000-\u00ff]", "?")


def confusion_table() -> dict[str, str]:
    """Suspect letter -> its possible readings, sorted."""
    return CONFUSED


def _suspects() -> str:
    return "".join(CONFUSED)


def confusion_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(c), f"[^{_suspects()}]", ""))


def confusion_score(c: Column | str) -> Column:
    """min(1, 3 x share of suspect letters among non-blank characters)."""
    c = _c(c)
    solid = F.length(strip_whitespace(c))
    return F.when(
        solid > 0, F.least(F.lit(1.0), confusion_count(c) / solid * F.lit(3.0))
    ).otherwise(F.lit(0.0))


def characters(c: Column | str) -> Column:
    """The characters of a text as an array, in one linear pass."""
    # an empty text splits into one empty string, which is no character
    return F.array_remove(F.split(_c(c), ""), "")


#: Characters of a piece in which two texts are compared, and of the longer pieces from which those are cut: a
#: position inside a string is found by walking to it.
PIECE, LONG_PIECE = 128, 1 << 15


def equal_positions(a: Column, b: Column) -> Column:
    """At how many positions two texts have the same character; pieces are compared, never arrays of whole texts."""

    def cut(x: Column, k: Column, size: int) -> Column:
        return F.substr(x, k * size + 1, F.lit(size))

    def numbers(n: Column, size: int) -> Column:
        last = F.floor((n - 1) / size).cast("int")
        return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def count(x: Column, y: Column) -> Column:
        same = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda c, d: c == d), lambda e: e))
        return F.when(x == y, F.length(x)).when((x == "") | (y == ""), 0).otherwise(same)

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0), lambda s, n: s + n)

    def long_count(x: Column, y: Column) -> Column:
        each = numbers(F.least(F.length(x), F.length(y)), PIECE)
        pieces = F.transform(each, lambda k: F.struct(cut(x, k, PIECE).alias("x"), cut(y, k, PIECE).alias("y")))
        return F.when(x == y, F.length(x)).otherwise(total(F.transform(pieces, lambda p: count(p["x"], p["y"]))))

    each = numbers(F.least(F.length(a), F.length(b)), LONG_PIECE)
    pieces = F.transform(each, lambda k: F.struct(cut(a, k, LONG_PIECE).alias("x"), cut(b, k, LONG_PIECE).alias("y")))
    return total(F.transform(pieces, lambda p: long_count(p["x"], p["y"])))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions in two texts, over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(longer > 0, equal_positions(a, b) / longer).otherwise(F.lit(1.0))


def local_id(uri: Column | str) -> Column:
    """Last path segment of a URI, before any ``#``."""
    return F.substring_index(F.substring_index(_c(uri), "/", -1), "#", 1)


def entity_kind(uri: Column | str) -> Column:
    """event, place or (everything else) person, from the local id."""
    local = local_id(uri)
    return (
        F.when(local.startswith("Event_"), "event")
        .when(local.startswith("Place_"), "place")
        .otherwise("person")
    )


def full_uri(short: Column | str, base: str) -> Column:
    """Full URI of an id; full URIs stay as they are."""
    short = _c(short)
    return F.when(short.startswith("http"), short).otherwise(F.concat(F.lit(base), short))


def is_page_text(text: Column, box_type: Column) -> Column:
    """True for boxes whose (trimmed) text belongs to the running text of a page."""
    return (
        (text != "")
        & ~F.coalesce(box_type, F.lit("ocr")).isin("ignore_region", "note")
        & ~text.startswith(REGION_MARK)
        & ~text.startswith(IGNORE_MARK)
    )


def engine_texts(vision: Column | str, classic: Column | str) -> Column:
    """distinct non-empty engine texts, vision first; fewer than two give null."""
    found = F.array_distinct(
        F.filter(F.array(strip(_c(vision)), strip(_c(classic))), lambda t: t.isNotNull() & (t != ""))
    )
    return F.when(F.size(found) >= 2, found)
