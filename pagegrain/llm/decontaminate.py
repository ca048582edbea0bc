"""Operator 5: benchmark decontamination by winnowing, in DataFrame functions only.

A text keeps, of every 9 consecutive five-word grams (13 words), those with the least hash. Both sides choose by the
words alone, so any 13 words that a document shares with an item have a chosen gram in common: the fingerprints join,
and each hit is extended word by word on both sides. Items of fewer words are looked up whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import store

WINDOW = 13
GRAM = 5
REACH = WINDOW - GRAM
#: Fingerprints of the benchmark that may be sent to all executors; a larger benchmark is joined by a shuffle.
SENT_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_words(df: DataFrame) -> DataFrame:
    """Adds ``words``: runs of digits, letters a-z and all characters beyond ASCII, A-Z made a-z; null has none."""
    parts = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    parts = F.filter(parts, lambda w: w != "")
    # only words with capitals are rewritten
    return df.withColumn("words", F.transform(parts, lambda w: F.when(w == F.lower(w), w).otherwise(F.translate(w, UPPER, LOWER))))


def _gram(start: str, size: str, h: str) -> str:
    """A gram with the words from REACH before to REACH after it, and how many of them stand before it."""
    return (
        f"named_struct('at', {start}, 'size', {size}, 'h', {h}, 'before', least({start} - 1, {REACH}), "
        f"'w', slice(words, greatest({start} - {REACH}, 1), least({start} - 1, {REACH}) + {size} + {REACH}))"
    )


def _next(a: str, b: str, k: int, body: str) -> str:
    """``body`` of each x of a list and the y that stands k places on in another, as far as both go."""
    n = f"greatest(least(size({a}), size({b}) - {k}), 0)"
    return f"zip_with(slice({a}, 1, {n}), slice({b}, {k + 1}, {n}), (x, y) -> {body})"


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``f``: the chosen grams, and all grams of the sizes in ``short``, each with the words around it.

    Words are hashed once; the hash of a gram is put together from those of its words, and least and greatest values
    over windows by doubling the window, so the work of a place doesn't grow with the sizes of grams and windows.
    """
    # a text of fewer words than a window has no grams
    out = df.withColumn("wh", F.expr(f"if(size(words) >= {WINDOW}, transform(words, w -> xxhash64(w)), array())"))
    out = out.withColumn("g2", F.expr(_next("wh", "wh", 1, "xxhash64(x, y)")))
    out = out.withColumn("g4", F.expr(_next("g2", "g2", 2, "xxhash64(x, y)")))
    out = out.withColumn("g", F.expr(_next("g4", "wh", 4, "xxhash64(x, y)")))  # GRAM is 5
    for name, of in (("m2", ("g", "g", 1)), ("m4", ("m2", "m2", 2)), ("m8", ("m4", "m4", 4)), ("m", ("m8", "g", 8))):  # REACH is 8
        out = out.withColumn(name, F.expr(_next(*of, "least(x, y)")))
    # a gram is chosen if it is the least of any of the windows that hold it: the greatest of their least values; as
    # windows end with the list, the greatest values are taken over a list with REACH lowest values before and after
    pad = f"array_repeat({-(1 << 63)}L, {REACH})".replace("-9223372036854775808L", "cast('-9223372036854775808' as bigint)")
    out = out.withColumn("p", F.expr(f"if(size(m) > 0, concat({pad}, m, {pad}), array())"))
    for name, of in (("x2", ("p", "p", 1)), ("x4", ("x2", "x2", 2)), ("x8", ("x4", "x4", 4)), ("top", ("x8", "p", 8))):
        out = out.withColumn(name, F.expr(_next(*of, "greatest(x, y)")))
    out = out.withColumn("c", F.expr("filter(zip_with(transform(g, (x, i) -> i + 1), zip_with(g, top, (x, y) -> x = y), (i, e) -> if(e, i, 0)), i -> i > 0)"))
    lists = [f"transform(c, i -> {_gram('i', str(GRAM), 'element_at(g, i)')})"]
    for n in short:
        each = _gram("i", str(n), f"xxhash64({n}, slice(words, i, {n}))")
        lists.append(f"if(size(words) >= {n}, transform(sequence(1, size(words) - {n - 1}), i -> {each}), array())")
    out = out.withColumn("f", F.expr(f"concat({', '.join(lists)})"))
    return out.drop("wh", "g2", "g4", "g", "m2", "m4", "m8", "m", "p", "x2", "x4", "x8", "top", "c")


def _gram_hash(words: str) -> str:
    """The hash of the five words of a list, as ``fingerprints`` puts it together."""
    w = [f"xxhash64(element_at({words}, {k}))" for k in range(1, GRAM + 1)]
    two = [f"xxhash64({w[0]}, {w[1]})", f"xxhash64({w[2]}, {w[3]})"]
    return f"xxhash64(xxhash64({two[0]}, {two[1]}), {w[4]})"


def item_fingerprints(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Fingerprints of the items with the words around them, and the sizes of items of fewer than 13 words."""
    items = with_words(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    items = items.filter(F.size("words") > 0).drop("text")
    sizes = items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # 12 at most
    rows = fingerprints(items, short).select("item_id", F.size("words").alias("n"), F.explode_outer("f").alias("i"))
    # (explode_outer: a filter that Spark infers for explode would be pushed into the expressions above it)
    # a short item is found whole, a long one by its chosen grams: only those have such a hash
    rows = rows.filter(f"if(n < {WINDOW}, i.size = n, i.at is not null)").withColumn("whole", F.expr(f"n < {WINDOW}"))
    chosen = _gram_hash(f"slice(i.w, i.before + 1, {GRAM})")
    rows = rows.filter(f"whole or (i.size = {GRAM} and i.h = {chosen})")
    return rows.select("item_id", F.col("i.h").alias("h"), "whole", F.struct("i.w", "i.before").alias("i")), short


def _same(a: str, b: str) -> str:
    """How many words two lists have in common from their beginnings."""
    z = f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)"
    return f"cast(if({z} = 0, greatest(size({a}), size({b})), {z} - 1) as int)"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of documents: ``doc_id``, text hash ``th``, ``n_words``, ``spans`` of hit words and found ``items``."""
    items, short = item_fingerprints(benchmark)
    items = store.keep(items, "fingerprints")
    if items.count() <= SENT_ROWS:
        items = F.broadcast(items)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = fingerprints(with_words(rows).drop("text"), short)
    # one entry without a hash stands for the document itself; words go no further than around their grams
    own = "named_struct('at', 0, 'size', 0, 'h', cast(null as bigint), 'before', 0, 'w', array(''))"
    rows = rows.select("doc_id", "th", F.size("words").alias("n"), F.explode_outer(F.expr(f"concat(array({own}), f)")).alias("d"))
    found = rows.join(items, F.col("d.h") == F.col("h"), "left").filter("d.at = 0 or h is not null")
    gram = "slice(d.w, d.before + 1, d.size) = slice(i.w, i.before + 1, d.size)"
    left = _same("reverse(slice(d.w, 1, d.before))", "reverse(slice(i.w, 1, i.before))")
    right = _same(*(f"slice({s}.w, {s}.before + 1 + d.size, {REACH})" for s in "di"))
    found = found.select(
        "doc_id", "th", "item_id", "whole", F.when(F.expr("d.at = 0"), F.col("n")).alias("n"), "d.at", "d.size",
        F.expr(f"d.at > 0 and {gram}").alias("equal"),
        F.expr(f"if(d.at = 0 or whole, 0, {left})").alias("left"),
        F.expr(f"if(d.at = 0 or whole, 0, {right})").alias("right"),
    )
    is_hit = F.expr(f"equal and (whole or left + size + right >= {WINDOW})")
    span = F.expr("named_struct('s', at - left, 'e', at + size + right)")
    return found.groupBy("doc_id", "th").agg(
        F.count("n").alias("rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("n_words"),
        F.array_sort(F.collect_set(F.when(is_hit, span))).alias("spans"),
        F.array_sort(F.collect_set(F.when(is_hit, F.col("item_id")))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document ``doc_id``, ``th``, ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    A document word inside any occurrence of 13 consecutive words of an item (or of a whole shorter item) is hit;
    ``contaminated`` means a hit, and hits for a twentieth of the words or more. Null and empty texts have no words
    and are clean; items without words match nothing, items without id count as hits but are not listed. Repeated
    rows give a row each. Other columns are not read; an empty benchmark leaves everything clean.
    """
    found = hits(docs, benchmark)
    union = (
        "aggregate(spans, named_struct('e', 0, 'n', 0), (a, x) -> named_struct('e', greatest(a.e, x.e), "
        "'n', a.n + greatest(x.e - greatest(a.e, x.s), 0)), a -> a.n)"
    )
    out = found.withColumn("n_hit", F.expr(union).cast("long")).withColumn("n_words", F.col("n_words").cast("long"))
    out = out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    out = out.withColumn("n_items", F.size("items").cast("long"))
    # equal rows were judged as one
    return out.withColumn("copy", F.explode(F.expr("sequence(1, rows)"))).select(
        "doc_id", "th", "n_words", "n_hit", "n_items", "items", "contaminated"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever these are called.

    Null and empty texts stay; rows of equal doc_id and text share their fate. An empty table gives no rows.
    """
    doc, th = store.fresh(docs, "__doc", "__th")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(doc), F.col("th").alias(th))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(th))
    return docs.join(bad.distinct(), on, "left_anti")


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    found = contamination(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
