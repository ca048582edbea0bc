"""Encoder, block files and packing against the library and by their invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagegrain.llm import encode, packing, planes, store
from tests_llm_rows import ROWS, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True
CODER = encode.Encoder(PATH, keep=500)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", " ", "\n", ".", ",", "'s", "é", "1", "\t", " ", "foo", "日", "\u0085", "x" * 60])), max_size=12))
def test_encoder_equals_library(parts):
    texts = ["".join(p) for p in parts] + [None]
    ids, n = CODER.batch(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert n.tolist() == [len(ids_of(t)) for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for n in (1, 7, 8, 1003):
        x = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (planes.from_planes(n, *planes.to_planes(x, bits)) == x).all()


def test_crc_join():
    parts = [b"", b"abc", b"d" * 1000, b"e"]
    assert planes.crc_join([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_block_files(spark, odd, none):
    path = store.folder(spark, "blocks")
    planes.write_blocks(odd, path, PATH, block_ids=1000)
    got = sorted((tuple(r) for r in planes.document_digests(spark, path).collect()), key=lambda r: r[1])
    want, at = [], 0
    order = [g[0] for g in got]
    assert order == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d))
    by_id = defaultdict(list)
    for d, t in ROWS:
        ids = ids_of(t) + [2]
        by_id[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d, start, n, crc in got:
        assert start == at and (n, crc) in by_id[d]
        by_id[d].remove((n, crc))
        at += n
    path = store.folder(spark, "blocks")
    planes.write_blocks(none, path, PATH)
    assert planes.document_digests(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.dictionaries(st.integers(1, 300), st.integers(1, 9)), st.integers(1, 40), st.integers(2, 8))
def test_plan_places_every_piece_once(size, counts, groups, small):
    counts = {k: v for k, v in counts.items() if k <= size}
    runs, n = packing.plan(counts, size, groups, size // small)
    used, ranks = defaultdict(list), defaultdict(list)
    for r in runs:
        ranks[r.length] += range(r.rank, r.rank + r.n)
        for k in range(r.n):
            used[r.seq + k].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert len(used) == n
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


def test_plan_is_tight():
    rng = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, int(rng.lognormvariate(6, 1)) + 1)] += 1
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert max(r.seq for r in packing.best_plan(counts, 2048)) + 1 <= 1.01 * bound


def test_packing(odd, none):
    got = [r.asDict() for r in packing.pack(odd, PATH, size=64).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for d, t in ROWS:
        if [r[0] for r in ROWS].count(d) > 1:
            continue
        ids, at = ids_of(t) + [0], 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(np.array(part, "<u4").tobytes()))
            assert k == 0 or r["length"] == 64
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(none, PATH).count() == 0


def test_queries(spark, sf_dir, texts):
    got = rows(planes.op3_bit_planes(spark, sf_dir))
    want, at = [], 0
    for d, t in sorted(texts):
        ids = ids_of(t) + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want, key=str)
