"""Texts that hold literals of added tokens, against the library with nothing changed."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagegrain.llm import encode, packing, planes, store

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = encode.Encoder(PATH, keep=500)
END = "<|endoftext|>"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_literal_gives_its_id():
    assert CODER.batch(pa.array([f"one.{END}two"]))[0].tolist() == [505, 13, 50256, 11545]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([END, END, "<|endof", "text|>", "a", " ", "\n", "  ", ".", "é", "'s", "1", "foo", "x" * 60])), max_size=8))
def test_literals_equal_library(parts):
    texts = ["".join(p) for p in parts] + [None]
    ids, n = CODER.batch(pa.array(texts, pa.string()))
    assert ids.dtype == np.uint32
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert n.tolist() == [len(ids_of(t)) for t in texts]


def test_literals_in_queries(spark):
    data = [(1, f"one \n{END}two"), (2, END), (3, None), (4, f"{END}{END} last  {END}"), (5, "plain text")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want, at = [], 0
    for d, t in data:
        ids = ids_of(t) + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    path = store.folder(spark, "blocks")
    planes.write_blocks(df, path, PATH)
    assert sorted(map(tuple, planes.document_digests(spark, path).collect())) == want
    got = sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pack(df, PATH).collect())
    assert got == [(d, len(ids_of(t)) + 1, zlib.crc32(np.array(ids_of(t) + [0], "<u4").tobytes())) for d, t in data]
