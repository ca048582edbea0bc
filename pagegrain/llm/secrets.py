"""Operator 8: secrets in texts, by base patterns and by character Markov models.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples:
what the base patterns find are the random strings, all other tokens that look alike are the ordinary ones. Tokens
whose log-likelihood ratio per character, of the whole or of the best stretch of 16 characters, passes a threshold are
added as spans of kind ``random``. The threshold comes from samples of both kinds that the models haven't seen.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import spans, store

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(
    r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]{6})(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)"
    r"(?:_(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+))*[0-9]{0,4}(?![A-Za-z0-9_])"
)
KINDS = ["assign", "access", "hex", "random"]
#: Characters of the models; all others share the last place.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Weight of single characters in the models, in observed pairs.
BACK = 20
#: Characters of a stretch, and how many of its transitions must be between letters and digits for it to be scored.
STRETCH, INNER = 16, 12
#: One of so many texts is held out for the threshold.
FOLDS = 5
#: The greatest threshold, and the one where either kind has fewer than ``FEW`` samples held out.
THRESHOLD, FEW = 0.5, 30
CODE = np.full(128, SIZE - 1, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def tokens(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of tokens of 16 and more characters that no base span overlaps."""
    taken = sorted(taken)
    starts = [s for s, _, _ in taken]
    reach = list(accumulate((e for _, e, _ in taken), max, initial=0))  # furthest end of the spans before each
    return [(m.start(), m.end()) for m in TOKEN.finditer(text) if reach[bisect_left(starts, m.end())] <= m.start()]


def transitions(words: list[str]) -> np.ndarray:
    """Counts of neighbouring characters, flat; the words are ASCII."""
    total = np.zeros(SIZE * SIZE, dtype=np.int64)
    for w in words:
        c = CODE[np.frombuffer(w.encode("ascii"), dtype=np.uint8)]
        np.add.at(total, c[:-1] * SIZE + c[1:], 1)
    return total


def ordinary(text: str) -> list[str]:
    """Words and identifiers that teach the ordinary model: parts in one case or humps, joined by _, digits at the end only."""
    return ORDINARY.findall(text)


def samples(text: str) -> tuple[list[str], list[str]]:
    """Ordinary words and identifiers of a text, and what the base patterns find."""
    found = base_spans(text)
    values = [text[s:e] for s, e, kind in found if kind != "assign"]
    values += [m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    rest, at = [], 0
    for s, e, _ in sorted(found):
        rest.append(text[at : max(s, at)])
        at = max(at, e)
    return ordinary(" ".join([*rest, text[at:]])), values


def _folded(docs: DataFrame) -> DataFrame:
    """Texts, and whether each is held out; equal texts agree in it."""
    text = F.col("text").cast("string")
    return docs.select(text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0).alias("held"))


def _log_ratios(total: np.ndarray) -> np.ndarray:
    """Log ratios of random to ordinary from the counts of both."""
    # pairs that are rare in a model lean on how common their second character is in it
    single = total.sum(axis=1, keepdims=True) + 1
    single = single / single.sum(axis=2, keepdims=True)
    logs = np.log((total + BACK * single) / (total.sum(axis=2, keepdims=True) + BACK))
    return logs[1] - logs[0]


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios from the neighbouring characters of all samples, and those from the texts that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            for text, held in zip(batch["text"].to_pylist(), batch["held"].to_pylist(), strict=True):
                if not text:
                    continue
                usual, values = samples(text)
                total[int(held), 1] += transitions(values)
                words = "\n".join(usual).encode("ascii")
                c = CODE[np.frombuffer(words, dtype=np.uint8)] if words else np.zeros(0, np.int64)
                inside = (c[:-1] < SIZE - 1) & (c[1:] < SIZE - 1)
                total[int(held), 0] += np.bincount((c[:-1] * SIZE + c[1:])[inside], minlength=SIZE * SIZE)
        held, kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int32)) for x in (held, kind, pair)] + [pa.array(total[held, kind, pair])],
            names=["held", "kind", "pair", "n"],
        )

    rows = _folded(docs).mapInArrow(run, "held int, kind int, pair int, n long")
    total = np.zeros((2, 2, SIZE, SIZE))
    for r in rows.groupBy("held", "kind", "pair").agg(F.sum("n").alias("n")).collect():  # at most 4 * 68 * 68 rows
        total[r["held"], r["kind"], r["pair"] // SIZE, r["pair"] % SIZE] = r["n"]
    return _log_ratios(total.sum(axis=0)), _log_ratios(total[0])


def calibrate(docs: DataFrame, log_ratio: np.ndarray) -> float:
    """The threshold with the least sum of both kinds' shares of errors, on the samples of all texts held out.

    Where a range of thresholds is best, its middle; at most ``THRESHOLD``, as the patterns find more of digits and
    hexadecimal strings than of letters, which score lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, bins = [], []
            for text in batch["text"].to_pylist():
                for kind, words in enumerate(samples(text or "")):
                    # tenths, as an aggregate counts them
                    found = [ratio(w, log_ratio) for w in words if len(w) >= STRETCH]
                    bins += [int(np.floor(10 * x)) for x in found if x > -np.inf]
                    kinds += [kind] * (len(bins) - len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(bins, pa.int32())], names=["kind", "bin"])

    rows = _folded(docs).filter("held").select("text").mapInArrow(run, "kind int, bin int")
    count = rows.groupBy("kind", "bin").count().collect()
    if not count:
        return THRESHOLD
    low = min(r["bin"] for r in count)
    hist = np.zeros((2, max(r["bin"] for r in count) - low + 1))
    for r in count:
        hist[r["kind"], r["bin"] - low] = r["count"]
    n = hist.sum(axis=1)
    if n.min() < FEW:
        return THRESHOLD
    below = np.concatenate([[0.0], np.cumsum(hist[1])]) / n[1]
    above = 1 - np.concatenate([[0.0], np.cumsum(hist[0])]) / n[0]
    best = np.flatnonzero(below + above <= (below + above).min() + 1e-12)
    return min(THRESHOLD, (low + (best[0] + best[-1]) / 2) / 10)


def ratio(word: str, log_ratio: np.ndarray) -> float:
    """Log-likelihood ratio per transition, of the whole or of its best stretch: high where a random string is likelier.

    Transitions to and from ``+/_=-``, which join parts, don't count; minus infinity where too few are left.
    """
    c = CODE[np.frombuffer(word.encode("ascii"), dtype=np.uint8)]
    inner = (c[:-1] < 62) & (c[1:] < 62)
    each = np.concatenate([[0.0], np.cumsum(np.where(inner, log_ratio[c[:-1], c[1:]], 0.0))])
    n = np.concatenate([[0], np.cumsum(inner)])
    step = min(STRETCH - 1, len(inner))
    totals = np.append(each[step:] - each[:-step], each[-1]) if step else each
    counts = np.append(n[step:] - n[:-step], n[-1]) if step else n
    some = counts >= INNER
    return float((totals[some] / counts[some]).max()) if some.any() else -np.inf


def digest(found: list[tuple[int, int, str]]) -> str:
    """kind:start:end of all spans by start, then kind as listed."""
    order = sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in order)


def scan(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """Per row of documents: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_random``.

    Positions are code points, ends exclusive. Null texts count as empty: no spans, and the digest of an empty string.
    Whole texts are scanned; repeated rows give a row each; other columns are not read; an empty table gives no rows
    (the models are then even, and nothing is added). Without ``threshold``, it is calibrated on samples held out.
    """
    log_ratio, unseen = train(docs)
    threshold = calibrate(docs, unseen) if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            rows = []
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                extra = [
                    (s, e, "random") for s, e in tokens(text, base)
                    if ratio(text[s:e], log_ratio) > threshold
                ]
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + extra), len(extra)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    )


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the models are trained on all of them."""
    return scan(store.documents(spark, sf_dir))
