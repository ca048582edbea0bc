"""Operator 13: ranked lexical search over K2-treaps of the term-document grid.

The documents are cut into ranges. Each range has a grid of its terms (rows, the most frequent first) and documents
(columns), whose filled cells hold impacts: what a term's occurrences in a document are worth before the term's
weight. A quadtree over the grid stores per cell which of its four quarters are filled and the greatest impact inside,
as the difference to its parent's; levels are compressed one by one. A search starts at the root with the rows of an
item's terms, splits column ranges in halves, moves each term's row path down with them, and always continues with the
range whose sum of weighted maxima is greatest, until no range can reach the best documents found so far.

The index is a table with a row per range, so it is built and searched by independent tasks. Weights come from
document frequencies over all ranges. Items are taken in blocks of bounded size, each against the whole index.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.llm import spans, store

#: A range ends at so many documents or bytes; a longer text is a range of its own.
RANGE_DOCS, RANGE_BYTES = 2048, 8 << 20
#: A block of items ends at so many items or bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20
#: Ranges of documents that a search splits at once.
WIDE = 32
TOP = 10
SPLIT = np.ones(256, dtype=bool)
SPLIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: By the mask of a cell's filled quarters and a quarter: its place among them, or -1.
PLACE = np.array([[bin(m & ((1 << q) - 1)).count("1") if m >> q & 1 else -1 for q in range(4)] for m in range(16)])
FILLED = np.array([bin(m).count("1") for m in range(16)])
INDEX = "docs binary, nulls binary, terms binary, dfs binary, height int, top long, masks array<binary>, drops array<binary>"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts in order, and the number of terms of each."""
    buf, starts, _ = spans.pack(texts)
    low = spans.LOWER[buf]
    s, e = spans.words(low, SPLIT)
    doc = np.searchsorted(starts, s, side="right") - 1
    return spans.hash_spans(low, s, e), np.bincount(doc, minlength=len(starts)).astype(np.int64)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for batch in spans.slices(batches, "text"):
            buf, starts, _ = spans.pack(batch["text"])
            s, _ = spans.words(buf, SPLIT)
            n = np.bincount(np.searchsorted(starts, s, side="right") - 1, minlength=len(starts))
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], names=["some", "total"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "some long, total long")
    row = got.agg(F.coalesce(F.sum("some"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return row[0], row[1]


def impacts(tf: np.ndarray, n: np.ndarray, some: int, total: int) -> np.ndarray:
    """Impact of ``tf`` occurrences in a document of ``n`` terms, before the term's weight."""
    if len(n) and 90 * int(n.max()) * some >= 1 << 63:
        n = n.astype(object)
    m = (10 + 90 * n * some // total).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, some: int) -> int:
    return math.floor(1000 * math.log((2 * some + 2) / (2 * df + 1)))


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to the even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def tree(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[int, int, list[np.ndarray], list[np.ndarray]]:
    """Levels of the quadtree over filled cells (distinct row and column, values above 0).

    Returns the height, the greatest value, the masks of filled quarters per level from the root down, and per level
    below the root how much less than its parent's each cell's greatest value is, in Morton order.
    """
    height = int(max(row.max(initial=0), col.max(initial=0))).bit_length()
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, most = code[order], value[order]
    masks: list[np.ndarray] = []
    drops: list[np.ndarray] = []
    for _ in range(height):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        quarter = (np.uint64(1) << (code & np.uint64(3))).astype(np.uint8)
        parent = np.maximum.reduceat(most, first)
        masks.append(np.bitwise_or.reduceat(quarter, first))
        drops.append(np.repeat(parent, np.diff(np.append(first, len(code)))) - most)
        code, most = up[first], parent
    return height, int(most[0]) if len(most) else 0, masks[::-1], drops[::-1]


class Tree:
    """A range's quadtree, its cells numbered from the root down; one more cell stands for all that are not filled."""

    def __init__(self, height: int, top: int, masks: list[np.ndarray], drops: list[np.ndarray]):
        self.height = height
        most, starts, begin = [np.array([top], dtype=np.int64)], [], 1
        for mask, drop in zip(masks, drops, strict=True):
            n = FILLED[mask]
            to = np.cumsum(n)
            starts.append(begin + to - n)
            most.append(np.repeat(most[-1], n) - drop)
            begin += int(to[-1])
        leaves = np.zeros(len(most[-1]) + 1, dtype=np.int64)
        self.most = np.concatenate([*most, [0]])
        self.mask = np.concatenate([*masks, leaves.astype(np.uint8)])
        self.start = np.concatenate([*starts, leaves])
        self.none = begin

    def best(self, rows: np.ndarray, w: np.ndarray, found: list[tuple], ids: list, k: int) -> list[tuple]:
        """The k best of ``found`` (negative score, no id, id) and the documents of this range, for weighted rows."""
        used = w > 0
        rows, w = rows[used], w[used]
        if not len(rows):
            return found
        floor = -found[k - 1][0] if len(found) >= k else 1
        first = int(self.most[0]) * int(w.sum())
        # greatest bound first; then the lowest level, so that full scores come early
        heap = [(-first, self.height, 0, 0, np.zeros(len(rows), dtype=np.int64))]
        number = 0
        while heap and -heap[0][0] >= floor:
            taken = []
            while heap and len(taken) < WIDE and -heap[0][0] >= floor:
                taken.append(heapq.heappop(heap))
            done = [(b, *ids[col]) for b, level, _, col, _ in taken if level == 0]
            if done:
                found = sorted([*found, *done])[:k]
                floor = -found[k - 1][0] if len(found) >= k else 1
            taken = [x for x in taken if x[1]]
            if not taken:
                continue
            level = np.array([x[1] for x in taken])
            cells = np.stack([x[4] for x in taken])
            mask, start = self.mask[cells], self.start[cells]
            quarter = (rows[None, :] >> (level[:, None] - 1) & 1) << 1
            for half in (0, 1):
                place = PLACE[mask, quarter | half]
                below = np.where(place < 0, self.none, start + place)
                bound = self.most[below] @ w
                for i in np.flatnonzero(bound >= floor):
                    number += 1
                    heapq.heappush(heap, (-int(bound[i]), int(level[i]) - 1, number, taken[i][3] << 1 | half, below[i]))
        return found


def build_index(docs: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """A row per range of documents; every row of ``docs`` is in one. ``size`` is that of the whole corpus.

    Null and empty texts have no terms; null ids stay null. Rows that share an id are documents of their own. An
    empty table gives no rows. Columns besides ``doc_id`` and ``text`` are not read.
    """
    some, total = size or corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.slices(batches, "text", most=RANGE_BYTES):
            for a in range(0, part.num_rows, RANGE_DOCS):
                yield pa.RecordBatch.from_pylist([_range(part.slice(a, RANGE_DOCS), some, total)], schema=schema)

    lists = pa.list_(pa.binary())
    kinds = {"height": pa.int32(), "top": pa.int64(), "masks": lists, "drops": lists}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in INDEX.split(", ")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


def _range(part: pa.RecordBatch, some: int, total: int) -> dict:
    hashes, n = terms_of(part["text"])
    docs = len(n)
    terms, term = np.unique(hashes, return_inverse=True)
    cell, tf = np.unique(term * docs + np.repeat(np.arange(docs), n), return_counts=True)
    dfs = np.bincount(cell // docs, minlength=len(terms))
    # the most frequent terms first: where rare terms meet, most cells stay empty
    row = np.empty(len(terms), dtype=np.int64)
    row[np.argsort(-dfs, kind="stable")] = np.arange(len(terms))
    col = cell % docs
    height, top, masks, drops = tree(row[cell // docs], col, impacts(tf, n[col], some, total))
    ids = part["doc_id"]
    return {
        "docs": _packed(ids.fill_null(0).to_numpy(zero_copy_only=False)),
        "nulls": _packed(np.asarray(ids.is_null())),
        "terms": _packed(np.stack([terms.view(np.int64), row])),
        "dfs": _packed(dfs.astype(np.int64)),
        "height": height,
        "top": top,
        "masks": [_packed(x) for x in masks],
        "drops": [_packed(x.astype(np.uint32)) for x in drops],
    }


def _frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the wanted terms (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for terms, dfs in zip(batch["terms"], batch["dfs"], strict=True):
                terms = _unpacked(terms.as_py(), "<u8")
                terms, dfs = terms[: len(terms) // 2], _unpacked(dfs.as_py(), "<i8")
                _, at, of = np.intersect1d(terms, wanted, assume_unique=True, return_indices=True)
                n[of] += dfs[at]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(n[some])], names=["t", "n"])

    got = index.select("terms", "dfs").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return {int(np.int64(r["t"]).view(np.uint64)): r["n"] for r in got.collect()}


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size: number, id and distinct terms of each."""
    block, size = [], 0
    for number, r in enumerate(items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator()):
        text = r["text"] or ""
        block.append((number, r["item_id"], np.unique(terms_of(pa.array([text]))[0])))
        size += len(text)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, some: int, k: int = TOP) -> DataFrame:
    """The k best documents of each item: ``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` above 0.

    ``some`` is the number of documents with a term. Equal scores come by ascending ``doc_id``, null ids last. Every
    row of items is ranked by itself, also where rows repeat or share an id; items without terms, or whose terms
    nobody has, give no rows.
    """
    out = None
    item = items.schema["item_id"].dataType.simpleString()
    for block in _blocks(items):
        wanted = np.unique(np.concatenate([t for _, _, t in block]))
        df = _frequencies(index, wanted)
        queries = []
        for number, id_, terms in block:
            w = np.array([weight(df[t], some) if t in df else 0 for t in terms.tolist()], dtype=np.int64)
            queries.append((number, id_, terms[w > 0], w[w > 0]))
        kept = _search_block(index, queries, item, k)
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        return items.sparkSession.createDataFrame([], f"item_id {item}, rank int, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("part")]
    # best of a sixty-fourth of the tasks each, then of those
    salted = Window.partitionBy("number", F.pmod("part", F.lit(64))).orderBy(*best)
    out = out.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*best))).filter(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, queries: list[tuple], item: str, k: int) -> DataFrame:
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch[c][r].as_py() for c in batch.schema.names}
                if not one["top"]:
                    continue
                ids = list(zip(_unpacked(one["nulls"], "?").tolist(), _unpacked(one["docs"], "<i8").tolist(), strict=True))
                terms = _unpacked(one["terms"], "<u8")
                terms, row = terms[: len(terms) // 2], terms[len(terms) // 2 :].astype(np.int64)
                masks = [_unpacked(x, "u1") for x in one["masks"]]
                grid = Tree(one["height"], one["top"], masks, [_unpacked(x, "<u4").astype(np.int64) for x in one["drops"]])
                for q, (_, _, wanted, w) in enumerate(queries):
                    at = np.searchsorted(terms, wanted)
                    has = at < len(terms)
                    has[has] = terms[at[has]] == wanted[has]
                    found[q] = grid.best(row[at[has]], w[has], found[q], ids, k)
        part = TaskContext.get().partitionId()
        rows = [(n, i, part, None if no else d, -s) for (n, i, _, _), f in zip(queries, found, strict=True) for s, no, d in f]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("number", "item_id", "part", "doc_id", "score"), r, strict=True)) for r in rows], schema=schema
        )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(item))
    schema = pa.schema(
        [("number", pa.int64()), ("item_id", kind), ("part", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]
    )
    return index.mapInArrow(run, f"number long, item_id {item}, part int, doc_id long, score long")


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = store.documents(spark, sf_dir)
    size = corpus_size(docs)
    index = store.keep(build_index(docs, size), "treaps")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size[0])


def _sql() -> str:
    """DuckDB form: all postings of the terms of the items."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    cut = rf"regexp_extract_all(translate(text, {letters}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {cut} AS t FROM documents),
size AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM docs),
tfs AS MATERIALIZED (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(t) AS w FROM docs) GROUP BY r, w),
weights AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tfs, size GROUP BY w),
items AS (SELECT DISTINCT q, item_id, w FROM (SELECT q, item_id, unnest(t) AS w FROM
  (SELECT row_number() OVER () AS q, item_id, {cut} AS t FROM benchmark))),
scores AS (SELECT q, item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) //
  (1000 * tf + 8 * (10 + CAST(90 * len(t) * n_docs AS BIGINT) // CAST(n_terms AS BIGINT))))) AS BIGINT) AS score
  FROM items JOIN tfs USING (w) JOIN weights USING (w) JOIN docs USING (r), size GROUP BY q, item_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""


OP13_SQL = _sql()
