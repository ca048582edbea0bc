"""Operator 11: codes of vector parts, by Lloyd rounds that look at active entries only.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook of its own, and a part's
code is its nearest entry. After a round only some entries have moved. A part whose own entry stayed where it was
keeps its stored distance and is compared with the moved entries alone; a part whose entry moved is compared with all.
All distances are exact integers and equal distances go to the lower index, so codes are those of full rescans.

The rows with their codes and distances are a table; a round reads one and writes the next. Only codebooks, and sums
of their size, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bytes of label totals that may be sent to all executors; more are joined by a shuffle.
SENT_BYTES = 8 << 20
#: Rows that are compared with a codebook at once.
STEP = 4096


@dataclass
class Codes:
    """``rows``: ``vec_id``, ``label``, ``codes`` (a byte per part) and ``error``. ``books``: [part, entry, position]."""

    rows: DataFrame
    books: np.ndarray


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index of equal ones; exact."""
    code, dist = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    small = 4 * x.shape[1] * top * top < 1 << 53  # doubles hold all sums
    for a in range(0, len(x), STEP):
        part = x[a : a + STEP]
        if small:
            f, b = part.astype(np.float64), book.astype(np.float64)
            d = (b * b).sum(1) - 2.0 * (f @ b.T)
            best = d.argmin(1)
            least = d[np.arange(len(part)), best] + (f * f).sum(1)
        else:
            d = np.zeros((len(part), len(book)), dtype=np.int64)
            for k in range(x.shape[1]):
                d += (part[:, k : k + 1] - book[:, k]) ** 2
            best = d.argmin(1)
            least = d[np.arange(len(part)), best]
        code[a : a + STEP], dist[a : a + STEP] = best, least
    return code, dist


def reassign(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after some moved, given those before: codes and exact distances.

    A kept entry was no worse than any other entry; of those only the moved ones can have become better.
    """
    code, dist = code.copy(), dist.copy()
    own_moved = moved[code]
    whole, kept, active = np.flatnonzero(own_moved), np.flatnonzero(~own_moved), np.flatnonzero(moved)
    if len(whole):
        code[whole], dist[whole] = nearest(x[whole], book)
    if len(kept) and len(active):
        c, d = nearest(x[kept], book[active])
        c = active[c]
        better = (d < dist[kept]) | ((d == dist[kept]) & (c < code[kept]))
        code[kept[better]], dist[kept[better]] = c[better], d[better]
    return code, dist


def _finite(v: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel(), kind))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            yield batch.slice(a, STEP)


def _assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Adds or renews ``codes`` and ``dist``. Without ``moved`` every part is compared with its whole codebook."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            v = _matrix(batch["v"], parts * width)
            code, dist = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
            if moved is not None:
                code = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(len(v), parts).astype(np.int64)
                dist = _matrix(batch["dist"], parts)
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width]
                if moved is None:
                    code[:, p], dist[:, p] = nearest(x, books[p])
                else:
                    code[:, p], dist[:, p] = reassign(x, books[p], moved[p], code[:, p], dist[:, p])
            codes = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], batch["v"], codes, _lists(dist, pa.int64())],
                names=["vec_id", "label", "v", "codes", "dist"],
            )

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, v array<int>, codes binary, dist array<long>")


def _means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means; entries without parts stay. Tasks send one sum per entry and position."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _pieces(batches):
            v = _matrix(batch["v"], parts * width)
            code = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(len(v), parts).astype(np.int64)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                for k in range(width):  # a piece's sums are below 2**53
                    total[p, :, k] += np.bincount(code[:, p], v[:, p * width + k], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        p, e, k = np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (p, e, k, n[p, e], total[p, e, k])], names=["p", "e", "k", "n", "total"]
        )

    sums = rows.select("v", "codes").mapInArrow(run, "p long, e long, k long, n long, total long")
    out = books.copy()
    for r in sums.groupBy("p", "e", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["p"], r["e"], r["k"]] = r["total"] // r["n"]
    return out


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codes:
    """Codes of all vectors (``vec_id``, ``embedding``, ``label``) and the codebooks after so many rounds.

    Vectors that are null or hold null or non-finite components are left out. The vector with the least ``vec_id``
    whose components can be dealt out evenly gives the length; vectors of another length are left out as well.
    Codebooks start as the parts of the ``entries`` least ids (ties by components, then label; null ids come last);
    of fewer vectors, as many entries as there are. Scaled components beyond an int of 32 bits, or so large that the
    error of a vector would pass a long, count as the largest that fits. Repeated rows are coded each. Other columns
    are not read; an empty table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & _finite(F.col("v")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v"), F.col("label")]
    size = next((len(r["v"]) for r in rows.orderBy(*order).select("v").limit(1).collect()), parts)
    # a vector's error is at most size * (2 * top)**2
    top = min((1 << 31) - 1, int(((1 << 62) // size) ** 0.5) // 2)
    ints = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(top))), F.lit(float(-top)))).cast("int"))
    rows = rows.filter(F.size("v") == size)
    seeds = [r["v"] for r in rows.orderBy(*order).limit(entries).select(ints.alias("v")).collect()]
    books = np.array(seeds, dtype=np.int64).reshape(len(seeds), parts, size // parts).transpose(1, 0, 2).copy()
    rows = rows.select("vec_id", "label", ints.alias("v"))
    if not seeds:
        return Codes(rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), books)
    now = store.keep(_assign(rows, books, None), "codes")
    for _ in range(rounds):
        new = _means(now, books)
        moved = (new != books).any(2)
        old, now, books = now, store.keep(_assign(now, new, moved), "codes"), new
        store.drop(old)
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x)
    return Codes(now.select("vec_id", "label", "codes", error.alias("error")), books)


def label_errors(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of errors of equal labels, nulls together; null where it passes a long."""
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    totals = store.keep(totals, "label-totals")
    size = totals.agg(F.sum(16 + F.coalesce(F.length(F.col("of").cast("string")), F.lit(0)) * 4)).first()[0] or 0
    if size <= SENT_BYTES:
        totals = F.broadcast(totals)
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all embeddings."""
    found = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = hashlib.sha256(",".join(map(str, found.books.ravel().tolist())).encode()).hexdigest()
    return label_errors(found.rows).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books).alias("codebooks_sha256")
    )


def _sql() -> str:
    """DuckDB form: the same rounds with full rescans."""
    size, parts = "(SELECT any_value(len(embedding)) FROM kept)", PARTS
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label) - 1 AS r, vec_id, "
        "label, embedding FROM embeddings WHERE len(embedding) > 0 "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"flat AS MATERIALIZED (SELECT r, i // ({size} // {parts}) AS p, i % ({size} // {parts}) AS k, "
        f"CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, unnest(embedding) AS x, "
        "unnest(range(len(embedding))) AS i FROM kept))",
        f"book0 AS MATERIALIZED (SELECT p, r AS e, k, v AS c FROM flat WHERE r < {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"near{n} AS MATERIALIZED (SELECT r, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d * {ENTRIES} + e) // {ENTRIES} AS d "
            "FROM (SELECT r, p, e, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d "
            f"FROM flat JOIN book{n} USING (p, k) GROUP BY r, p, e) GROUP BY r, p)"
        )
        if n < ROUNDS:
            steps.append(
                f"book{n + 1} AS MATERIALIZED (SELECT p, e, k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM book{n} "
                f"LEFT JOIN (SELECT p, e, k, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM near{n} JOIN flat USING (r, p) "
                "GROUP BY p, e, k) USING (p, e, k))"
            )
    return (
        f"WITH {', '.join(steps)}, "
        f"done AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r), "
        "marked AS (SELECT * FROM kept JOIN done USING (r)) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM book{ROUNDS}) AS codebooks_sha256 FROM marked"
    )


OP11_SQL = _sql()
