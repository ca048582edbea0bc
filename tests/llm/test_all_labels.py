"""The threshold of op1 comes from all labelled rows."""

import numpy as np

from pagegrain.llm import rules


def test_ranks_of_values(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.random(3000), np.full(500, 0.25), 0.25 + np.arange(5) * 2.0**-54])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for rank in (0, 17, 900, 2000, len(v) - 1):
        assert rules.nth(df, rank, 16) == np.sort(v)[rank]


def test_threshold_covers_all_labels(spark):
    words = "the of and to in is that for with as on was by at from".split()
    rng = np.random.default_rng(5)
    data = []
    for i in range(400):
        text = " ".join(rng.choice(words) + str(rng.integers(9)) * int(rng.integers(2)) for _ in range(60))
        data.append((i, text + " #" * int(rng.integers(0, 30))))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(400)], "doc_id long, quality int")
    got = rules.judge(docs, labels, trees=20, sample=16, most_rows=30, most_lost=0.01).collect()
    good = sorted((r["score"], r["kept"]) for r in got if r["doc_id"] % 10 and not r["base_failed"])
    # of n good rows those above the rank go, though only 30 of them grew the trees
    n = len(good)
    limit = good[int(np.ceil((n - 1) * 0.99))][0]
    assert n > 100 and [k for _, k in good] == [s <= limit for s, _ in good]
