"""Token ids of whole texts, by the tokenizers library, with repeated pieces encoded once.

A byte-level vocabulary splits a text into pieces and merges inside pieces only, and a piece doesn't depend on what
stands before it. Two kinds of places always are bounds of pieces: between an ASCII letter and another ASCII
character, and before a single space, or around a line feed, that no white space follows. Texts are cut there; equal cuts share
their ids. Cuts are known by a 64-bit hash; a table bounded by ``keep`` holds the ids of those met so far, and the
library encodes the rest in bulk. Literals of added tokens (``<|endoftext|>``) come first, as in the library: they
give their id, and what lies between two of them is encoded as a text of its own.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute

from pagegrain.llm import spans

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
ASCII = np.arange(256) < 128
LEAD = np.zeros(256, dtype=bool)
LEAD[[32, 10]] = True
#: Bytes that surely start no white space: no control or blank, no lead byte of a multi-byte space.
SOLID = np.arange(256) > 32
SOLID[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
LONGEST = 48
ROWS = 128


class Encoder:
    """Ids of batches of texts. ``keep``: how many cuts the table may hold before it starts anew."""

    def __init__(self, path: str, keep: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take blanks or need word bounds are not supported")
        self.added = {t.content: k for k, t in added.items() if t.content}
        # the longest of those that start at one place
        literals = sorted(self.added, key=len, reverse=True)
        self.literal = re.compile("(" + "|".join(map(re.escape, literals)) + ")") if literals else None
        # the same merges for a list of words, one per line
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # in order
        self.place = np.zeros(0, dtype=np.int64)  # first id in the pool * 64 + number of ids
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _encode(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts one after the other, and the number of each."""
        texts = [c.decode() for c in cuts]
        is_word = np.array([t.isalpha() or (t[0] == " " and t[1:].isalpha()) for t in texts], dtype=bool)
        sizes = np.zeros(len(texts), dtype=np.int64)
        at, ids = np.flatnonzero(is_word), []
        words = [texts[k] for k in at.tolist()]
        for a in range(0, len(words), ROWS):
            got = self.words.encode("\n".join(words[a : a + ROWS]), add_special_tokens=False)
            ids.append(np.array(got.ids, dtype=np.uint32))
            sizes[at[a : a + ROWS]] = np.bincount(got.word_ids)
        other = np.flatnonzero(~is_word).tolist()
        for k, got in zip(other, self.whole.encode_batch([texts[k] for k in other], add_special_tokens=False), strict=True):
            ids.append(np.array(got.ids, dtype=np.uint32))
            sizes[k] = len(ids[-1])
        order = np.concatenate([at, np.array(other, dtype=np.int64)])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if len(other) and len(at):  # from words first to the order asked for
            begin = np.zeros(len(texts), dtype=np.int64)
            begin[order] = np.cumsum(sizes[order]) - sizes[order]
            to = np.cumsum(sizes)
            flat = flat[np.arange(to[-1]) + np.repeat(begin - (to - sizes), sizes)]
        return flat, sizes

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes in the table, -1 where missing."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, self.place[k], -1)

    def _learn(self, h: np.ndarray, cuts: list[bytes]) -> None:
        ids, sizes = self._encode(cuts)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        place = (self.used + np.cumsum(sizes) - sizes) * 64 + sizes
        self.used += len(ids)
        at = np.searchsorted(self.hashes, h)
        self.hashes, self.place = np.insert(self.hashes, at, h), np.insert(self.place, at, place)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (unsigned 32-bit), and the number of ids of each text."""
        has = [pa.compute.any(pa.compute.match_substring(texts, x)).as_py() for x in self.added]
        if not any(has):
            return self._between(texts)
        parts, literals, counts = [], [], []
        for text in texts.to_pylist():
            found = self.literal.split(text or "")  # text, literal, text, ..., text
            parts += found[::2]
            literals += found[1::2]
            counts.append(len(found) // 2)
        ids, sizes = self._between(pa.array(parts, pa.string()))
        counts = np.array(counts, dtype=np.int64)
        last = np.cumsum(counts + 1) - 1  # the part that ends each text
        inner = np.ones(len(parts), dtype=bool)
        inner[last] = False
        to = np.cumsum(sizes)
        ids = np.insert(ids, to[inner], np.array([self.added[x] for x in literals], dtype=np.uint32))
        return ids, np.diff(to[last], prepend=0) + counts

    def _between(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``batch``, for texts without literals of added tokens."""
        buf, starts, ends = spans.pack(texts)
        full = ends > starts
        is_cut = np.zeros(len(buf) + 1, dtype=bool)
        letter = LETTER[buf]
        is_cut[1:-1] = letter[:-1] & ASCII[buf[1:]] & ~letter[1:]
        is_cut[:-2] |= LEAD[buf[:-1]] & SOLID[buf[1:]]
        is_cut[1:-1] |= (buf[:-1] == 10) & SOLID[buf[1:]]
        is_cut[starts] = is_cut[ends] = True
        at = np.flatnonzero(is_cut)
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = (doc >= 0) & (at < ends[np.maximum(doc, 0)]) & full[np.maximum(doc, 0)] if len(starts) else at < 0
        s, e, doc = at[inside], at[np.flatnonzero(inside) + 1], doc[inside]
        h = spans.hash_spans(buf, s, e)
        long = np.flatnonzero(e - s > LONGEST)
        uniq, first, which = np.unique(h, return_index=True, return_inverse=True)
        is_long = (e - s)[first] > LONGEST
        if len(self.hashes) + len(uniq) > self.keep and len(self.hashes):
            self._clear()
        place = self._find(uniq)
        miss = np.flatnonzero((place < 0) & ~is_long)
        if len(miss):
            self._learn(uniq[miss], [buf[s[k] : e[k]].tobytes() for k in first[miss]])
            place[miss] = self._find(uniq[miss])
        sizes = (place % 64)[which]
        begin = (place // 64)[which]
        pool = self.pool[: self.used]
        if len(long):  # encoded each time, kept for this batch only
            ids, n = self._encode([buf[s[k] : e[k]].tobytes() for k in long])
            sizes[long], begin[long] = n, len(pool) + np.cumsum(n) - n
            pool = np.concatenate([pool, ids])
        to = np.cumsum(sizes)
        index = np.arange(to[-1] if len(to) else 0) + np.repeat(begin - (to - sizes), sizes)
        per_doc = np.bincount(doc, weights=sizes, minlength=len(starts)).astype(np.int64)
        return pool[index], per_doc


_SHARED: dict[str, Encoder] = {}


def shared(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _SHARED:
        _SHARED[path] = Encoder(path)
    return _SHARED[path]
