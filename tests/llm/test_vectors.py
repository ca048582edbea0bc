"""Vector codes against full rescans by plain numbers."""

import hashlib
import math

import numpy as np
import pytest

import compare
from pagegrain.llm import vectors


def plain(rows, parts=16, entries=64, rounds=2):
    """Full rescans with Python numbers: (id, label) rows with codes and errors, and the codebooks."""
    kept = [
        (i, v, y) for i, v, y in rows
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    data = [[[math.floor(256 * x) for x in v[p * w : (p + 1) * w]] for p in range(parts)] for _, v, _ in kept]
    books = [[d[p] for d in data[:entries]] for p in range(parts)]
    for n in range(rounds + 1):
        near = [
            [min((sum((a - b) ** 2 for a, b in zip(d[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            for d in data
        ]
        if n < rounds:
            new = []
            for p in range(parts):
                own = [[d[p] for d, c in zip(data, near, strict=True) if c[p][1] == k] for k in range(len(books[p]))]
                new.append([[sum(x) // len(o) for x in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)])
            books = new
    out = [(i, y, bytes(c[1] for c in near_).hex(), sum(c[0] for c in near_)) for (i, _, y), near_ in zip(kept, near, strict=True)]
    return out, books


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame(
        [(i, v, y, 1.0, "x") for i, v, y in rows], f"vec_id long, embedding array<{kind}>, label int, v double, codes string"
    )
    got = vectors.encode(df, **options)
    return sorted(((r["vec_id"], r["label"], r["codes"].hex(), r["error"]) for r in got.rows.collect()), key=str), got.books


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    some = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.3, 32))], int(i) % 3 or None) for i in range(120)]
    same = [(500 + k, some[7][1], 7) for k in range(40)]
    odd = [
        (3, None, 1), (4, [], 1), (5, [0.5] * 31 + [None], 2), (6, [0.5] * 31 + [math.nan], 2), (6, [math.inf] + [0.5] * 31, 2),
        (None, [0.25] * 32, None), (2, [1.0] * 16, 2), (8, some[8][1], some[8][2]), (9, [0.5] * 33, 1), (700, [-0.001] * 32, 1),
    ]
    want, books = plain(some + same + odd)
    got, found_books = found(spark, some + same + odd)
    assert got == sorted(want, key=str)
    assert found_books.tolist() == books


@pytest.mark.parametrize("entries", [1, 5, 64])
def test_active_entries_equal_full_rescans(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 16)], 0) for i in range(150)]  # many equal distances
    want, books = plain(rows, entries=entries, rounds=4)
    got, found_books = found(spark, rows, "double", entries=entries, rounds=4)
    assert got == sorted(want, key=str) and found_books.tolist() == books


def test_few_and_no_rows(spark):
    assert found(spark, [])[0] == []
    got, books = found(spark, [(1, [0.5] * 16, None)])
    assert got == [(1, None, "00" * 16, 0)] and books.shape == (16, 1, 1)
    huge = found(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], entries=1)[0]
    assert all(r[3] >= 0 for r in huge)


def test_reassign_by_moved_entries():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-4, 5, (2000, 3)), rng.integers(-4, 5, (20, 3))
    code, dist = vectors.nearest(x, book)
    new = book.copy()
    new[[2, 3, 11]] += [[1, 0, -1], [0, 2, 0], [-1, -1, 0]]
    for a, b in zip(vectors.reassign(x, new, (new != book).any(1), code, dist), vectors.nearest(x, new), strict=True):
        assert (a == b).all()
    wide = x * (1 << 26)  # beyond what doubles hold
    assert (vectors.nearest(wide, book * (1 << 26))[0] == code).all()


def test_label_errors(spark):
    rows = [(1, 5, 10), (2, 5, 20), (3, None, 1), (4, None, 2), (5, 6, 1 << 62), (6, 6, 1 << 62)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    got = {r["vec_id"]: r["label_error"] for r in vectors.label_errors(df).collect()}
    assert got == {1: 30, 2: 30, 3: 3, 4: 3, 5: None, 6: None}


def test_query(spark, con, sf_dir):
    assert compare.compare(spark, con, vectors.op11_vector_codes, vectors.OP11_SQL, sf_dir) is None
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = plain(rows)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    got = vectors.op11_vector_codes(spark, sf_dir).collect()
    assert {(r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in got} == {(i, c, e, digest) for i, _, c, e in want}
