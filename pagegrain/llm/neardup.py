"""Operator 7: near duplicates by min-max hashing.

Each permutation (a random odd multiplier and an offset modulo 2**64) keeps the least and the greatest value over a
document's shingles: two signature values from one pass. Bands of the signature are the keys by which candidates
meet; links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import groups, spans, store

SHINGLE = 5


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of each text (not yet distinct), and their number; A-Z count as a-z.

    A text of fewer words is one shingle; a text without words, or null, has none.
    """
    buf, starts, ends = spans.pack(texts)
    low = spans.LOWER[buf]
    s, e = spans.words(low)
    h = spans.hash_spans(low, s, e)
    doc = np.searchsorted(starts, s, side="right") - 1
    n = np.bincount(doc, minlength=len(starts))
    g = spans.grams(h, SHINGLE)
    inside = doc[: len(g)] == doc[SHINGLE - 1 :] if len(g) else np.zeros(0, dtype=bool)
    values, of = g[inside], doc[: len(g)][inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        first = np.cumsum(n) - n
        whole = np.array([_fold(h[first[k] : first[k] + n[k]]) for k in short], dtype=np.uint64)
        at = np.searchsorted(of, short)
        values, of = np.insert(values, at, whole), np.insert(of, at, short)
    return values, np.bincount(of, minlength=len(starts)).astype(np.int64)


def _fold(h: np.ndarray) -> np.uint64:
    """The hash of a short text as one shingle; its number of words counts."""
    out = np.full(1, len(h), dtype=np.uint64)
    for x in h:
        out = spans.mix(out * spans.BASE + x)
    return out[0]


def signatures(values: np.ndarray, sizes: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """Band keys of each non-empty set: least and greatest value under half as many permutations as values."""
    perms = -(-bands * rows // 2)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, perms, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), 2 * perms), dtype=np.uint64)
    for k in range(perms):
        v = values * a[k] + b[k]
        out[:, 2 * k] = np.minimum.reduceat(v, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, first)
    keys = np.empty((len(sizes), bands), dtype=np.uint64)
    for j in range(bands):
        key = np.full(len(sizes), j, dtype=np.uint64)
        for c in range(j * rows, (j + 1) * rows):
            key = spans.mix(key * spans.BASE + out[:, c])
        keys[:, j] = key
    return keys


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per row of documents: ``doc_id``, set size ``n``, a 128-bit fingerprint of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text", most=2 << 20):
            values, sizes = shingles(batch["text"])
            n, prints = np.zeros(len(sizes), dtype=np.int64), np.zeros((len(sizes), 2), dtype=np.uint64)
            for k, part in enumerate(np.split(values, np.cumsum(sizes)[:-1])):
                if len(part):
                    part = np.unique(part)
                    n[k] = len(part)
                    prints[k] = spans.mix(part).sum(), spans.mix(part ^ spans.BASE).sum()
            full = np.flatnonzero(sizes)
            keys = signatures(values, sizes[full], bands, rows) if len(full) else np.zeros((0, bands), np.uint64)
            at = np.zeros(len(sizes) + 1, dtype=np.int32)
            at[1:] = np.cumsum((sizes > 0) * bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n),
                    pa.array(np.ascontiguousarray(prints[:, 0]).view(np.int64)),
                    pa.array(np.ascontiguousarray(prints[:, 1]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["doc_id", "n", "f1", "f2", "keys"],
            )

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, bands: int = 26, rows: int = 5) -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked where den * intersection >= num * union of their shingle sets; a component's id is its least
    ``doc_id``, and only that document is kept. Equal sets meet by fingerprint and go on as one. With 26 bands of 5
    values a pair at similarity 0.85 misses all bands with probability 3e-7, at 0.8 with 3e-5.

    Null and empty texts and texts without words have no shingles and link with nothing. Rows without ``doc_id``
    take no part: their component is null and they are kept. Where rows share a ``doc_id``, all its texts count for its
    links and each row shows the component of its own text. Columns besides ``doc_id`` and ``text`` are not read; an empty table gives no rows.
    """
    signed = store.keep(sign(docs, bands, rows), "signatures")
    some = signed.filter("n > 0 and doc_id is not null")
    classes = store.keep(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = some.join(classes, ["f1", "f2"]).filter("doc_id = rep")
    keyed = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    copies = classes.groupBy(F.col("rep").alias("id")).agg(F.max("copies").alias("copies"))

    def fetch(ids: DataFrame, count: int) -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("content"))
        return texts.join(groups.small_side(ids, count), "id", "left_semi")

    comps = groups.link(keyed, copies, fetch, shingles, num, den)
    out = signed.select("doc_id", "n", "f1", "f2").join(classes.drop("copies"), ["f1", "f2"], "left")
    out = out.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "rep", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, **options) -> DataFrame:
    """The documents but for near duplicates: of each component of similar texts one row stays, the first by ``doc_id``
    and text hash.

    Texts are linked, not ids, so rows that share a ``doc_id`` are decided one by one; of rows with equal ``doc_id``
    and text one stays, also where the text has no words. Rows without ``doc_id`` take no part and stay.
    """
    doc, th = store.fresh(docs, "__doc", "__th")
    text = F.col("text").cast("string")
    rows = docs.withColumns({doc: F.col("doc_id").cast("long"), th: F.xxhash64(text)})
    some = rows.filter(F.col(doc).isNotNull())
    by_text = near_duplicates(some.select(F.col(th).alias("doc_id"), text.alias("text")), num, den, **options)
    by_text = by_text.groupBy(F.col("doc_id").alias(th)).agg(
        F.min("component_id").alias("comp"), F.max("n_shingles").alias("n")
    )
    by_text = store.keep(by_text, "components")
    placed = some.select(doc, th).join(by_text.filter("n > 0"), th)
    place = F.struct(doc, th)
    firsts = placed.groupBy("comp").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.filter("first <> last").select("comp", "first")
    gone = placed.join(firsts, "comp").filter(place != F.col("first")).select(doc, th).distinct()
    left = rows.join(store.keep(gone, "gone"), [doc, th], "left_anti")
    pairs = some.groupBy(doc, th).count().filter("count > 1").select(doc, th)
    pairs = store.keep(pairs, "repeated")
    if not pairs.isEmpty():
        once = left.join(pairs, [doc, th], "left_semi").dropDuplicates([doc, th])
        # a null id equals nothing and stays
        left = left.join(pairs, [doc, th], "left_anti").select(*rows.columns).unionByName(once.select(*rows.columns))
    return left.select(*docs.columns)


def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at a similarity of 0.85."""
    return near_duplicates(store.documents(spark, sf_dir))
