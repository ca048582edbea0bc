"""Vectorised work on the bytes of a batch of texts: slices of batches, word bounds, hashes of byte spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


#: Seed of a second hash that is independent of the first.
SECOND = np.uint64(0xD1B54A32D192ED03)
#: Longer spans are hashed by the hashes of their pieces of so many bytes.
PIECE = 512


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A 64-bit hash of each span of bytes: every eight bytes are mixed into the state before the next eight.

    The state passes the bijective mixer between steps, so no arithmetic of powers can cancel: texts that collide
    under a sum of powers (complementary Thue-Morse strings) differ here.
    """
    starts, n = np.asarray(starts, dtype=np.int64), np.asarray(ends - starts, dtype=np.int64)
    size = n.astype(np.uint64)
    out = mix((size ^ seed) * BASE + seed)
    words = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    left = np.flatnonzero((n > 0) & (n <= PIECE))
    step = 0
    while len(left):
        rest = n[left] - 8 * step
        lane = words[starts[left] + 8 * step]
        tail = rest < 8
        lane[tail] &= (np.uint64(1) << (np.uint64(8) * rest[tail].astype(np.uint64))) - np.uint64(1)
        out[left] = mix((out[left] ^ lane) * BASE)
        left = left[rest > 8]
        step += 1
    long = np.flatnonzero(n > PIECE)
    if len(long):
        pieces = -(-n[long] // PIECE)
        to = np.cumsum(pieces)
        at = np.repeat(starts[long], pieces) + PIECE * (np.arange(to[-1]) - np.repeat(to - pieces, pieces))
        each = hash_spans(buf, at, np.minimum(at + PIECE, np.repeat((starts + n)[long], pieces)), seed)
        bound = 8 * np.concatenate([[0], to])
        whole = hash_spans(each.view(np.uint8), bound[:-1], bound[1:], seed)
        out[long] = mix((out[long] ^ whole) * BASE)
    return out


def slices(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = (pa.compute.fill_null(pa.compute.binary_length(batch[c]), 0) for c in columns)
        sizes = sum(e.to_numpy(zero_copy_only=False).astype(np.int64) for e in each)
        run = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(run)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def pack(texts: pa.Array, between: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts with the byte ``between`` before, between and after them, and each text's bounds."""
    parts = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    sep = bytes([between])
    buf = np.frombuffer(sep + sep.join(parts) + sep, dtype=np.uint8)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(np.concatenate([[1], sizes[:-1] + 1])) if len(parts) else np.zeros(0, dtype=np.int64)
    return buf, starts, starts + sizes


def words(buf: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of bytes that aren't blank; the first and last bytes of ``buf`` are blank."""
    edge = np.flatnonzero(np.diff(blank[buf]))
    return edge[0::2] + 1, edge[1::2] + 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, by the hashes of the items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mix(out * BASE + h[j : n + j])
    return out
