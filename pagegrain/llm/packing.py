"""Operator 6: best-fit packing by linear grouping.

Lengths are at most ``size``, so a histogram of them is small whatever the corpus is; the plan is made on it. Large
lengths are sorted and cut into groups of equal cardinality, each rounded up to its greatest length. Configurations
of these few sizes are chosen one after the other, the fullest that the remaining counts allow, each as often as
they allow. The true lengths then take their places, and the small lengths go best-fit into the room that is left.
A plan is a list of runs (length, first rank, sequences, offset); pieces find their run by their rank among the
pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegrain.llm import encode, spans, store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """Pieces of one length, ranks ``rank`` to ``rank + n - 1``, go to sequences ``seq`` and on, at ``offset``."""

    length: int
    rank: int
    n: int
    seq: int
    offset: int


class _Stock:
    """The pieces of each length that are not placed yet."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.rank = dict(counts), defaultdict(int)

    def take(self, length: int, n: int) -> int:
        rank = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        return rank


def _groups(counts: dict[int, int], large: list[int], k: int) -> list[list[int]]:
    """Large lengths in descending order, cut where the running count passes a k-th of the total."""
    total, run, out = sum(counts[s] for s in large), 0, []
    for s in large:
        at = min(k - 1, run * k // max(total, 1))
        while len(out) <= at:
            out.append([])
        out[at].append(s)
        run += counts[s]
    return [g for g in out if g]


def _fullest(sizes: list[int], left: list[int], size: int) -> list[int]:
    """How often each size is in the fullest configuration that uses the largest size left at least once."""
    first = next(k for k, n in enumerate(left) if n)
    reach = [None] * (size + 1)  # for each sum, the last group used and the sum before
    start = sizes[first]
    reach[start] = (first, 0)
    known = [start]
    for k, s in enumerate(sizes):
        n = left[k] - (k == first)
        layer = known
        for _ in range(min(n, size // s)):
            layer = [t + s for t in layer if t + s <= size and reach[t + s] is None and not reach.__setitem__(t + s, (k, t))]
            if not layer:
                break
            known = known + layer
    at, used = max(known), [0] * len(sizes)
    while at:
        k, at = reach[at]
        used[k] += 1
    return used


def plan(counts: dict[int, int], size: int, groups: int = 32, small: int | None = None) -> tuple[list[Run], int]:
    """Runs for all pieces of the histogram, and the number of sequences. ``small``: the greatest small length."""
    small = size // 5 if small is None else small
    stock, runs, seq = _Stock(counts), [], 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)
    levels: list[int] = []

    def leave(left: int, at: int, n: int) -> None:
        if left and n:
            if not room[left]:
                insort(levels, left)
            room[left].append((at, n))

    large = sorted((s for s in counts if s > small), reverse=True)
    grouped = _groups(counts, large, groups)
    queues = [deque((s, counts[s]) for s in g) for g in grouped]
    left, sizes = [sum(counts[s] for s in g) for g in grouped], [g[0] for g in grouped]
    while any(left):
        used = _fullest(sizes, left, size)
        times = min(left[k] // u for k, u in enumerate(used) if u)
        slots = [k for k, u in enumerate(used) for _ in range(u)]
        for k, u in enumerate(used):
            left[k] -= u * times
        # each slot of a group takes its own share of the group's pieces
        shares = []
        for k in slots:
            share, need = deque(), times
            while need:
                s, n = queues[k].popleft()
                share.append((s, min(n, need)))
                if n > need:
                    queues[k].appendleft((s, n - need))
                need -= min(n, need)
            shares.append(share)
        while times:
            n, offset = min(share[0][1] for share in shares), 0
            for share in shares:
                s, m = share.popleft()
                if m > n:
                    share.appendleft((s, m - n))
                runs.append(Run(s, stock.take(s, n), n, seq, offset))
                offset += s
            leave(size - offset, seq, n)
            seq, times = seq + n, times - n
    for s in sorted((s for s in counts if s <= small), reverse=True):
        while n := stock.left[s]:
            k = bisect_left(levels, s)
            if k == len(levels):
                per = size // s
                full, rest = divmod(n, per)
                for j in range(per if full else 0):
                    runs.append(Run(s, stock.take(s, full), full, seq, j * s))
                leave(size - per * s, seq, full)
                seq += full
                for j in range(rest):
                    runs.append(Run(s, stock.take(s, 1), 1, seq, j * s))
                leave(size - rest * s, seq, int(rest > 0))
                seq += rest > 0
                break
            gap = levels[k]
            at, m = room[gap].pop()
            if not room[gap]:
                levels.pop(k)
            t = min(n, m)
            runs.append(Run(s, stock.take(s, t), t, at, size - gap))
            leave(gap, at + t, m - t)
            leave(gap - s, at, t)
    return runs, seq


def best_plan(counts: dict[int, int], size: int) -> list[Run]:
    """The plan with the fewest sequences over some numbers of groups and bounds of small lengths."""
    found = [plan(counts, size, g, size // s) for g in (16, 64, 256) for s in (3, 6)]
    return min(found, key=lambda f: f[1])[0]


def cut_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0) -> DataFrame:
    """Encodes every text (null: empty), appends ``end_id`` and cuts documents of over ``size`` ids.

    All pieces but the first have ``size`` ids; the first takes what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encode.shared(tokenizer)
        for batch in spans.slices(batches, "text"):
            ids, sizes = coder.batch(batch["text"])
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4")
            raw, at, rows = memoryview(ids).cast("B"), 0, []
            for doc, n in zip(batch["doc_id"].to_pylist(), (sizes + 1).tolist(), strict=True):
                start = 0
                for piece in range(-(-n // size)):
                    m = n - (n - 1) // size * size if piece == 0 else size
                    rows.append((doc, piece, start, m, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + m)])))
                    start += m
                at += n
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Adds ``rank`` among the pieces of equal length. ``most`` pieces share a length at most: it sets the salts."""
    keys, order = ["length", "salt"], ["doc_id", "piece", "start", "ids_crc32"]
    salts = 1 + most // 50_000
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return salted.withColumn("inner", inner).join(base, keys).withColumn("rank", F.col("base") + F.col("inner"))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs whole documents into sequences of at most ``size`` ids; one row per piece.

    Null texts count as empty (one id). Rows with equal ids are documents of their own; columns besides ``doc_id``
    and ``text`` are not read. An empty table gives no rows. The plan holds some runs per length, so what goes to the
    tasks is bounded by ``size``, not by the corpus.
    """
    pieces = store.keep(cut_pieces(docs, tokenizer, size, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = sorted(best_plan(counts, size))
    # ranks of a length are far from those of the next, so that one search finds the run
    top = max(counts.values(), default=0) + 1
    keys = np.array([r.length * top + r.rank for r in runs], dtype=np.int64)
    first, seq, offset = (np.array([r[k] for r in runs], dtype=np.int64) for k in (1, 3, 4))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() * top + rank, side="right") - 1
            found = [pa.array(seq[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + found, names=[*names, "sequence_id", "offset"])

    rows = ranked(pieces, max(counts.values(), default=0)).select(*names, "rank")
    return rows.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    return pack(store.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
