"""The near-duplicate stage where ids and rows repeat."""

import random
from collections import Counter

import corpus_pipeline
from test_duplicates import linked, shingles


def text(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(80))


def test_repeated_ids(spark, sf_dir):
    a, b, c = text(1), text(2), text(3)
    near = b + " more"
    data = [
        (3, b), (5, a), (5, near), (7, a),  # 7 goes as a copy of 5's first text, 5's second text as one like 3's
        (8, c), (8, c), (9, c),  # one row of c
        (10, ""), (10, ""), (11, ""), (12, None), (12, None),  # repeated rows without words
        (None, a), (None, a),  # no part
        (13, text(4)), (13, text(5)), (2, text(5)),  # 13's other text isn't lost
    ]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(3, b), (5, a), (8, c), (10, ""), (11, ""), (12, None), (None, a), (None, a), (13, text(4)), (2, text(5))])


def test_unique_ids(spark, sf_dir, docs, texts):
    comp = linked({d: shingles(t) for d, t in texts}, 80, 100)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    assert got == sorted(d for d in comp if comp[d] == d)
