"""Operator 1: quality rules, and an isolation forest over their statistics.

Random trees split the statistics of a bounded sample; a document that random splits isolate early (short paths) is
an anomaly. The score above which documents go is calibrated on labelled rows: of those that pass the base rules and
are labelled good, no more than ``most_lost`` may go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import spans, store

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bytes", "n_lines", "n_upper", "n_punct", "n_digits", "n_distinct", "n_single"]
STATS = "doc_id long, th long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
PUNCT = np.isin(np.arange(256), list(b"!\"'()+-/:;=?@[\\]^_`{}~"))
#: Spreads small ratios before the logarithm; in the order of ``features``.
SCALE = np.array([1, 100, 20, 100, 100, 20, 20, 20])
WINDOW = 5


def counts(texts: pa.Array) -> np.ndarray:
    """COUNTS and MORE of each text, one row per text."""
    buf, starts, ends = spans.pack(texts)
    n = len(starts)
    total = np.zeros(len(buf) + 1, dtype=np.int64)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    out = {"n_bytes": ends - starts}
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_punct", PUNCT)):
        out[name] = per_doc(table[buf])
    out["word_chars"] = per_doc(~spans.BLANK[buf] & ((buf & 0xC0) != 0x80))
    s, e = spans.words(buf)
    doc = np.searchsorted(starts, s, side="right") - 1
    out["n_words"] = np.bincount(doc, minlength=n)
    out["n_single"] = np.bincount(doc[e - s == 1], minlength=n)
    h = spans.hash_spans(buf, s, e)
    out["n_distinct"] = _distinct(doc, h, n)

    g = spans.grams(h, WINDOW)
    at = np.flatnonzero(doc[: len(g)] == doc[WINDOW - 1 :]) if len(g) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((g[at], doc[at]))
    gs, ds = g[at][order], doc[at][order]
    same = (gs[1:] == gs[:-1]) & (ds[1:] == ds[:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=n)

    feeds = np.flatnonzero(buf == 10)
    ls, le = feeds[:-1] + 1, feeds[1:]
    # lines that hold the start of a word
    with_word = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[with_word], le[with_word]
    ldoc = np.searchsorted(starts, ls, side="right") - 1
    out["n_lines"] = np.bincount(ldoc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(ldoc, spans.hash_spans(buf, ls, le), n)
    return np.stack([np.asarray(out[c], dtype=np.int64) for c in COUNTS + MORE], axis=1)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each document has."""
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    return np.bincount(ds[new], minlength=n)


def statistics(docs: DataFrame) -> DataFrame:
    """COUNTS and MORE per row of documents; ``th`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text", most=2 << 20):
            table = counts(batch["text"])
            cols = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(table.shape[1])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *cols], names=["doc_id", "th", *COUNTS, *MORE])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, STATS)


def features(table: np.ndarray) -> np.ndarray:
    """Logarithms of ratios of the counts; rows as in ``counts``."""
    c = dict(zip(COUNTS + MORE, table.T.astype(np.float64), strict=True))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1)
    ratios = np.stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_upper"] / chars,
            c["n_punct"] / chars,
            c["n_digits"] / chars,
            c["n_single"] / words,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
        ],
        axis=1,
    )
    return np.log1p(ratios * SCALE)


def grow(rows: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int, sample: int, seed: int = 1) -> dict:
    """Isolation trees as arrays over heap positions: split feature (-1 in leaves), split value, path length of leaves.

    A node splits its box, not the range of its rows: so a value that no row of the sample has is split off early
    even where all rows agree.
    """
    rng = np.random.default_rng(seed)
    sample = min(sample, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    size = 1 << (depth + 1)
    feature, value, path = np.full((trees, size), -1, np.int16), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(1, rows[rng.choice(len(rows), sample, replace=False)], 0, *box)]
        while todo:
            at, part, level, low, high = todo.pop()
            wide = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(wide):
                path[t, at] = level + mean_path(len(part))
                continue
            f = rng.choice(wide)
            v = rng.uniform(low[f], high[f])
            feature[t, at], value[t, at] = f, v
            left, below, above = part[:, f] < v, high.copy(), low.copy()
            below[f] = above[f] = v
            todo += [(2 * at, part[left], level + 1, low, below), (2 * at + 1, part[~left], level + 1, above, high)]
    return {"feature": feature, "value": value, "path": path, "depth": depth, "mean": mean_path(sample)}


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def scores(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
    total = np.zeros(len(x))
    row = np.arange(len(x))
    for feature, value, path in zip(forest["feature"], forest["value"], forest["path"], strict=True):
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(forest["depth"]):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, 2 * at + (x[row, np.maximum(f, 0)] >= value[at]), at)
        total += path[at]
    return 2.0 ** (-total / len(forest["path"]) / max(forest["mean"], 1e-9))


def failed(table: np.ndarray) -> np.ndarray:
    """Fewer than 10 words, or over a fifth of the words in repeated five-word windows."""
    words, repeats = table[:, COUNTS.index("n_words")], table[:, COUNTS.index("n_repeat_words")]
    return (words < 10) | (100 * repeats > 20 * words)


def _fails() -> Column:
    """``failed`` as a column."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


FEATURES = [f"f{i}" for i in range(8)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(np.stack([batch[c].to_numpy() for c in COUNTS + MORE], axis=1))
        good = pa.array(batch["quality"].to_numpy() == 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), good], names=[*FEATURES, "good"])


def threshold(good: DataFrame, forest: dict, most_lost: float) -> float:
    """The least score of which at most a share of ``most_lost`` of all good rows is above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.stack([batch[c].to_numpy() for c in COUNTS + MORE], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(scores(forest, x))], names=["v"])

    values = store.keep(good.mapInArrow(run, "v double"), "scores")
    n = values.count()
    return nth(values, int(np.ceil((n - 1) * (1 - most_lost))))


def nth(values: DataFrame, rank: int, buckets: int = 4096) -> float:
    """The value ``v`` of a rank from 0: counts of buckets, then of the buckets of the one that holds it, and so on."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        bucket = F.least(F.floor((F.col("v") - low) / ((high - low) / buckets)), F.lit(buckets - 1))
        inside = values.filter(F.col("v").between(low, high)).groupBy(bucket.alias("b"))
        for r in inside.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def judge(
    docs: DataFrame,
    labels: DataFrame,
    trees: int = 100,
    sample: int = 256,
    most_rows: int = 20_000,
    most_lost: float = 0.003,
) -> DataFrame:
    """Per row of documents: ``doc_id``, COUNTS, ``base_failed``, ``kept``, ``score``, and the text's hash ``th``.

    Each tree sees ``sample`` of at most ``most_rows`` good labelled rows (those least by a hash of doc_id); the bounds
    of the trees and the threshold come from all labelled rows. Without labelled rows of both kinds only the base rules decide. Null and empty texts
    have zero counts and fail the base rules; of several labels of one id the least counts; rows without doc_id are judged like others but never labelled; a text of
    any length is counted whole; other columns are not read; an empty table gives no rows.
    """
    table = store.keep(statistics(docs), "statistics")
    known = labels.filter("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = store.keep(table.join(known, "doc_id").filter(~_fails()), "labelled")
    seen = known.mapInArrow(_features, ", ".join(f"{c} double" for c in FEATURES) + ", good boolean")
    bounds = [f(c) for f in (F.min, F.max) for c in FEATURES]
    *ends, bad = seen.agg(*bounds, F.count_if(~F.col("good"))).first()
    # the trees draw from rows least by hash; bounds and threshold come from all labelled rows
    rows = known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(most_rows)
    got = np.array([tuple(r) for r in rows.select(*COUNTS, *MORE).collect()], dtype=np.int64)
    forest, limit = None, np.inf
    if len(got) >= 2:
        # trees learn what is usual from good rows, inside the bounds of all labelled rows
        forest = grow(features(got), tuple(np.array(ends).reshape(2, -1)), trees, sample)
        if bad:
            limit = threshold(known.filter("quality = 1"), forest, most_lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[c].to_numpy() for c in COUNTS + MORE], axis=1)
            bad = failed(x)
            score = scores(forest, features(x)) if forest else np.zeros(len(x))
            cols = [batch[c] for c in ["doc_id", *COUNTS]]
            cols += [pa.array(bad), pa.array(~bad & (score <= limit)), pa.array(score), batch["th"]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "base_failed", "kept", "score", "th"])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return table.mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, kept boolean, score double, th long")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules and the forest keep, with all their columns, whatever these are called.

    Rows of equal doc_id and text share their fate; null and empty texts have too few words and go. An empty table
    gives no rows.
    """
    doc, th = store.fresh(docs, "__doc", "__th")
    bad = judge(docs, labels).filter("not kept").select(F.col("doc_id").alias(doc), F.col("th").alias(th))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(th))
    return docs.join(bad.distinct(), on, "left_anti")


def op1_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, calibrated on the table of labels."""
    return judge(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("th")
