"""Operator 10: fuzzy duplicate lines by MinHash over character shingles.

Lines are trimmed of white space; a line's set is its shingles of eight characters (a shorter line is one shingle).
One changed character unshares as many shingles as one has characters, which is too much in short lines: lines of
fewer than 99 characters are compared by shingles of four characters too, and either similarity links them.
Equal lines meet by hash, bands of the signature make candidates of the others, exact Jaccard similarity on the sets
confirms them, and the connected components keep one line each: the first by doc_id, text hash and line number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import groups, spans, store

CHARS = 8
#: Shingles of short lines. Below 79 characters one inner change leaves less than 0.8 of the long shingles; a line of 78
#: can be like one of a quarter more.
SHORT_CHARS, SHORT = 4, 99
#: From so many values on a set is signed by one permutation. Bits of a hash beside the number of its line.
MANY, HASH_BITS = 96, 44


def _trim(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without blanks at their ends; spans of blanks only become empty."""
    solid = np.flatnonzero(~spans.BLANK[buf])
    first = np.searchsorted(solid, s)
    last = np.searchsorted(solid, e) - 1
    some = last >= first
    if not len(solid):
        return s, s
    top = len(solid) - 1
    return np.where(some, solid[np.minimum(first, top)], s), np.where(some, solid[np.maximum(last, 0)] + 1, s)


def _chars(buf: np.ndarray, s: np.ndarray, e: np.ndarray, chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of non-empty spans (not distinct), and their number; ``chars`` is 8 at most.

    The low bytes of a shingle's characters are one word; what is above them is summed up and mixed in where there is any.
    """
    low, high, a, z = buf, None, s, e
    if len(buf) and buf.max() >= 128:
        index = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=index[1:])
        points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        low, high, a, z = points.astype(np.uint8), points >> np.uint32(8), index[s], index[e]
    n = np.maximum(z - a - chars + 1, 1)
    to = np.cumsum(n)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(a - (to - n), n)
    words = np.ndarray(len(low) + 1, "<u8", np.concatenate([low, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    h = words[at]
    if chars < 8:
        h &= np.uint64((1 << 8 * chars) - 1)
    less = np.flatnonzero(z - a < chars)
    if len(less):
        # a shorter line is one shingle; its length counts
        size, of = (z - a)[less].astype(np.uint64), (to - n)[less]
        h[of] = h[of] & ((np.uint64(1) << np.uint64(8) * size) - np.uint64(1)) ^ spans.mix(size)
    h = spans.mix(h ^ spans.SECOND)
    if high is not None and high.any():
        up, down = spans.powers(len(high) + 1)
        total = np.zeros(len(high) + 1, dtype=np.uint64)
        np.cumsum(high.astype(np.uint64) * up[:-1], out=total[1:])
        above = total[np.minimum(at + chars, np.repeat(z, n))] - total[at]
        some = np.flatnonzero(above)
        h[some] = spans.mix(h[some] ^ spans.mix(above[some] * down[at[some]]))
    return h, n


def line_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of whole lines, for the exact check."""
    buf, s, e = spans.pack(texts)
    return _chars(buf, s, e)


def short_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shorter shingles of whole lines."""
    buf, s, e = spans.pack(texts)
    return _chars(buf, s, e, SHORT_CHARS)


def _is_short(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether spans have fewer than ``SHORT`` characters."""
    index = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=index[1:])
    return index[e] - index[s] < SHORT


def _least(values: np.ndarray, n: np.ndarray, bands: int, rows: int, seed: int = 10) -> np.ndarray:
    """Band keys of the least values under ``bands * rows`` permutations of 32-bit hashes."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint64) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    first = np.cumsum(n) - n
    keys = np.empty((len(n), bands), dtype=np.uint64)
    v = np.empty_like(values)
    for j in range(bands):
        key = np.full(len(n), j, dtype=np.uint64)
        for c in range(j * rows, (j + 1) * rows):
            np.multiply(values, a[c], out=v)
            np.add(v, b[c], out=v)
            key = spans.mix(key * spans.BASE + np.minimum.reduceat(v, first))
        keys[:, j] = key
    return keys


def _next(ordered: np.ndarray, sets: np.ndarray, first: np.ndarray, n: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys by one permutation: the ``rows`` values from each of ``bands`` places of its circle on.

    ordered: sets' numbers and below them, in order, ``HASH_BITS`` bits of hash. Of two sets' union the values next to a
    place are a random choice, as the least ones under a permutation are.
    """
    places = (np.arange(bands, dtype=np.uint64) << np.uint64(HASH_BITS)) // np.uint64(bands)
    to = np.searchsorted(ordered, (sets.astype(np.uint64)[:, None] << np.uint64(HASH_BITS) | places).ravel())
    to = to.reshape(len(sets), bands) - first[:, None]
    keys = np.broadcast_to(np.arange(bands, 2 * bands, dtype=np.uint64), to.shape)
    for t in range(rows):
        value = ordered[first[:, None] + (to + t) % n[:, None]] & np.uint64((1 << HASH_BITS) - 1)
        keys = spans.mix(keys * spans.BASE + value)
    return keys


def band_keys(h: np.ndarray, n: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of non-empty sets of hashes (not distinct), and the number of the set that each is of.

    Sets of fewer than ``MANY`` values have the least values under many permutations, larger ones those of one
    permutation, and those that can be similar to both have both.
    """
    count = len(n)
    ordered = np.repeat(np.arange(count, dtype=np.uint64), n) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS)
    ordered.sort()
    ordered = ordered[np.append(True, ordered[1:] != ordered[:-1])]
    of = (ordered >> np.uint64(HASH_BITS)).astype(np.int64)
    n = np.bincount(of, minlength=count)
    few, many = 4 * n < 5 * MANY, np.flatnonzero(n >= MANY)
    keys, sets = [], []
    if few.any():
        values = (ordered[few[of]] >> np.uint64(HASH_BITS - 32) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        keys.append(_least(values, n[few], bands, rows).ravel())
        sets.append(np.repeat(np.flatnonzero(few), bands))
    if len(many):
        keys.append(_next(ordered, many, (np.cumsum(n) - n)[many], n[many], bands, rows).ravel())
        sets.append(np.repeat(many, bands))
    return np.concatenate(keys), np.concatenate(sets)


def _lines(text: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of texts, and of each line that isn't blank: bounds, text and number in it."""
    buf, starts, _ = spans.pack(text)
    feeds = np.flatnonzero(buf == 10)
    s, e = feeds[:-1] + 1, feeds[1:]
    doc = np.searchsorted(starts, s, side="right") - 1
    begin = np.searchsorted(s, starts)
    line = np.arange(len(s)) - begin[np.maximum(doc, 0)] if len(s) else s
    s, e = _trim(buf, s, e)
    some = e > s
    return buf, s[some], e[some], doc[some], line[some]


def hash_lines(docs: DataFrame) -> DataFrame:
    """A row per line that isn't blank: ``doc_id``, hash ``th`` of the text, ``line``, hashes ``h``, ``h2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text", most=1 << 20):
            buf, s, e, doc, line = _lines(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(doc)),
                    batch["th"].take(pa.array(doc)),
                    pa.array(line.astype(np.int32)),
                    pa.array(spans.hash_spans(buf, s, e).view(np.int64)),
                    pa.array(spans.hash_spans(buf, s, e, spans.SECOND).view(np.int64)),
                ],
                names=["doc_id", "th", "line", "h", "h2"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, line int, h long, h2 long")


def line_keys(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Band keys of lines, packed (see ``groups.packed``); the last bit tells those of the shorter shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in spans.slices(batches, "text", most=1 << 20):
            buf, s, e, _, _ = _lines(batch["text"])
            h, at = np.unique(spans.hash_spans(buf, s, e).view(np.int64), return_index=True)
            s, e = s[at], e[at]
            # a long text is gone through in runs of lines
            run_of = np.cumsum(e - s) >> 20
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(s)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y == x:
                    continue
                keys, of = band_keys(*_chars(buf, s[x:y], e[x:y]), bands, rows)
                yield keys & ~np.uint64(1), h[x:y][of]
                short = np.flatnonzero(_is_short(buf, s[x:y], e[x:y])) + x
                if len(short):
                    keys, of = band_keys(*_chars(buf, s[short], e[short], SHORT_CHARS), bands, rows)
                    yield keys | np.uint64(1), h[short][of]

    return groups.packed(_keyed(docs), run)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _pick(rows: DataFrame) -> DataFrame:
    """The text of one line for each row of ``h``, ``text``, ``line``."""
    line = F.element_at(F.split("text", "\n"), F.col("line") + 1)
    trimmed = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return rows.select(F.col("h").alias("id"), trimmed.alias("content"))


def line_decisions(
    docs: DataFrame, num: int = 80, den: int = 100, bands: int = 22, rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """All lines that aren't blank (``doc_id``, ``th``, ``line``), and those of them that are removed.

    Lines are linked where den * intersection >= num * union of their shingle sets, short lines also where this holds
    for their sets of shorter shingles. With 22 bands of 4 values a pair at similarity 0.8 misses all bands with
    probability 9e-6, at 0.9 with 6e-11.
    """
    lines = store.keep(hash_lines(docs), "lines")
    shared = store.keep(groups.meeting(line_keys(docs, bands, rows)), "candidates")
    # two texts under one hash are told apart by the second hash; their lines stay
    classes = lines.groupBy("h").agg(F.count("*").alias("copies"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
    classes = store.keep(classes, "line-classes")
    copies = classes.select(F.col("h").alias("id"), "copies")

    def fetch(ids: DataFrame, count: int) -> DataFrame:
        wanted = lines.join(groups.small_side(ids.withColumnRenamed("id", "h"), count), "h", "left_semi")
        # one place of each line: its least document and there its least line
        at = wanted.groupBy("h").agg(F.min(F.struct("doc_id", "th", "line")).alias("p")).select("h", "p.*")
        per_doc = at.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "line")).alias("w"))
        found = _keyed(docs).dropDuplicates(["doc_id", "th"]) if _repeated(docs) else _keyed(docs)
        on = found["doc_id"].eqNullSafe(per_doc["doc_id"]) & found["th"].eqNullSafe(per_doc["th"])
        text = found.join(groups.small_side(per_doc, 4 * count), on).select("text", F.explode("w").alias("w"))
        return _pick(text.select("text", "w.h", "w.line"))

    comps = None
    for bit, sets_of in enumerate((line_sets, short_sets)):
        found = groups.link_shared(shared.filter(F.col("key").bitwiseAND(1) == bit), copies, fetch, sets_of, num, den)
        comps = groups.joined(comps, found.select(F.col("id").alias("a"), F.col("comp").alias("b"))) if comps is not None else found
    # lines that occur several times or are like others
    several = classes.filter("copies > 1").select("h").unionByName(comps.select(F.col("id").alias("h")))
    several = several.unionByName(comps.select(F.col("comp").alias("h"))).distinct()
    several = several.join(classes.filter("lo <> hi").select("h"), "h", "left_anti")
    placed = lines.select("doc_id", "th", "line", "h").join(several, "h")
    placed = placed.join(comps.withColumnRenamed("id", "h"), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    place = F.struct("doc_id", "th", "line")
    firsts = placed.groupBy("comp").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.filter("first <> last").select("comp", "first")
    removed = placed.join(firsts, "comp").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "line")
    return lines.select("doc_id", "th", "line"), removed


def _repeated(docs: DataFrame) -> bool:
    """Whether rows repeat a ``doc_id``."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def dedupe_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents without their duplicate lines; other columns stay, ``n_chars`` (where there is one) is set anew.

    Blank lines never match and stay. A document that loses its last line that isn't blank goes; null and empty
    texts stay as they are. Rows with equal doc_id and text count as one place, so both keep or lose the same lines.
    A null doc_id orders first. An empty table gives no rows.
    """
    _, removed = line_decisions(docs, **options)
    per_doc = removed.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone"))
    doc, th, gone = store.fresh(docs, "__doc", "__th", "__gone")
    per_doc = per_doc.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("gone").alias(gone))
    text = F.col("text").cast("string")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.xxhash64(text).eqNullSafe(F.col(th))
    rows = docs.join(per_doc, on, "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = rows.withColumn("text", F.when(F.col(gone).isNull(), text).otherwise(left))
    out = out.filter(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its lines and which of them (from 0) are removed."""
    docs = store.documents(spark, sf_dir)
    lines, removed = line_decisions(docs)
    marked = lines.withColumn("gone", F.lit(None).cast("int")).unionByName(removed.withColumn("gone", F.col("line")))
    per_doc = marked.groupBy("doc_id", "th").agg(
        (F.count("*") - F.count("gone")).alias("n_lines"), F.sort_array(F.collect_list("gone")).alias("removed_lines")
    )
    ids = _keyed(docs).select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    on = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("t").eqNullSafe(F.col("th"))
    out = ids.join(per_doc, on, "left")
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select(
        F.col("d").alias("doc_id"),
        F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        gone.alias("removed_lines"),
    )
