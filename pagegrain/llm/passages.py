"""Operator 9: document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (ratios of character classes, word lengths and
repeats, and the mean of pseudo-random signs of its words); a hidden layer, gated attention weights and a logistic
layer are learned from the document labels by gradient descent, and the weighted passage representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import rules, spans, store

PASSAGE = 64
SIGNS = 32
WIDTH = 8 + SIGNS


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each; a text without words has one."""
    buf, starts, _ = spans.pack(texts)
    s, e = spans.words(buf)
    doc = np.searchsorted(starts, s, side="right") - 1
    n = np.bincount(doc, minlength=len(starts))
    bags = np.maximum(-(-n // PASSAGE), 1)
    to = np.cumsum(bags)
    within = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
    of = (to - bags)[doc] + within // PASSAGE
    x = np.zeros((int(to[-1]) if len(to) else 0, WIDTH), dtype=np.float32)
    if not len(s):
        return x, bags
    first = np.flatnonzero(np.diff(of, prepend=-1))
    rows, size = of[first], np.diff(np.append(first, len(s)))
    total = np.zeros(len(buf) + 1, dtype=np.int64)
    a, z = s[first], e[np.append(first[1:], len(s)) - 1]
    chars = (z - a).astype(np.float32)
    for k, table in enumerate((rules.SYMBOL, rules.UPPER, rules.PUNCT, rules.DIGIT)):
        np.cumsum(table[buf], out=total[1:])
        x[rows, k] = np.minimum(10 * (total[z] - total[a]) / chars, 5)
    length = (e - s).astype(np.float32)
    mean = np.add.reduceat(length, first) / size
    x[rows, 4] = mean / 8
    x[rows, 5] = np.sqrt(np.maximum(np.add.reduceat(length * length, first) / size - mean * mean, 0)) / 8
    h = spans.hash_spans(spans.LOWER[buf], s, e)
    x[rows, 6] = 1 - rules._distinct(of, h, len(x))[rows] / size
    x[rows, 7] = np.log1p(size) / 4
    bits = np.unpackbits((h >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4), axis=1)
    sums = np.add.reduceat(bits, first, axis=0, dtype=np.float32)
    x[rows, 8:] = (2 * sums / size[:, None] - 1) * 2
    return x, bags


def _forward(w: dict, x: np.ndarray, bags: np.ndarray):
    """Hidden rows, gates, weights per passage, and the logit of each bag."""
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (v * u) @ w["a"]
    first = np.cumsum(bags) - bags
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), bags))
    a = a / np.repeat(np.add.reduceat(a, first), bags)
    pooled = np.add.reduceat(h * a[:, None], first, axis=0)
    return h, v, u, a, pooled, pooled @ w["c"] + w["d"]


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 12, seed: int = 9) -> dict:
    """Weights by Adam on the mean log-loss over bags, in batches of 64 bags."""
    rng = np.random.default_rng(seed)
    w = {
        "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "b": np.zeros(hidden),
        "V": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)), "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
        "a": rng.normal(0, 1 / np.sqrt(gate), gate), "c": rng.normal(0, 1 / np.sqrt(hidden), hidden), "d": np.zeros(1),
    }
    m, s = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    first, step = np.cumsum(bags) - bags, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 64):
            pick = order[k : k + 64]
            n = bags[pick]
            at = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            xb, seg = x[at].astype(np.float64), np.repeat(np.arange(len(pick)), n)
            h, v, u, a, pooled, logit = _forward(w, xb, n)
            err = (1 / (1 + np.exp(-logit)) - y[pick]) / len(pick)
            dp = err[:, None] * w["c"]
            da = (h * dp[seg]).sum(1)
            start = np.cumsum(n) - n
            da = a * (da - np.add.reduceat(a * da, start)[seg])
            dv, du = da[:, None] * w["a"] * u * (1 - v * v), da[:, None] * w["a"] * v * u * (1 - u)
            dh = a[:, None] * dp[seg] + dv @ w["V"].T + du @ w["U"].T
            dz = dh * (1 - h * h)
            grads = {
                "W": xb.T @ dz, "b": dz.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ da,
                "c": pooled.T @ err, "d": np.array([err.sum()]),
            }
            step += 1
            for name, grad in grads.items():
                grad = grad + 1e-4 * w[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                s[name] = 0.999 * s[name] + 0.001 * grad * grad
                w[name] = w[name] - 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(doc_id) -> F.Column:
    """Rows that never teach: the CRC-32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 4_000) -> dict | None:
    """Learns from at most ``most_docs`` labelled documents, those least by a hash of doc_id, held-out rows excepted.

    All passages of each are used. None without labels of both kinds.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            x, bags = encode(batch["text"])
            parts = np.split(x, np.cumsum(bags)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["y"], pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "y", "x"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # one text of each labelled id, the least by its hash, so that no more than most_docs come to the driver
    rows = rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("id", "y", "text").mapInArrow(run, "id long, y int, x binary")
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in rows.collect())
    y = np.array([g[1] for g in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(g[2], np.float32).reshape(-1, WIDTH) for g in got]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score(docs: DataFrame, weights: dict | None, cut: float = 0.3) -> DataFrame:
    """Per row of documents: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts are scored as one passage without words. Without weights every score is 0.5. Rows without
    doc_id are scored and count as not held out; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text", most=2 << 20):
            x, bags = encode(batch["text"])
            logit = _forward(weights, x.astype(np.float64), bags)[-1] if weights else np.zeros(len(bags))
            p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= cut).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the table of labels."""
    docs = store.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
