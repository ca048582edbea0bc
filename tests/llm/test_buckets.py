"""Buckets of variants: pairs stay inside tasks, and no link is lost."""

import random

import numpy as np
import pytest

from pagegrain.llm import groups, linedup
from test_duplicates import removed_lines


@pytest.mark.parametrize("most", [1_536, 20])
def test_variants_make_no_pairs(spark, monkeypatch, most):
    """Variants just below the threshold: what is fetched and compared by rows stays in proportion to the lines."""
    monkeypatch.setattr(groups, "CELL_ROWS", most, raising=False)
    compared, verify = [], groups.verify

    def counted(pairs, *args):
        compared.append(pairs.count())
        return verify(pairs, *args)

    monkeypatch.setattr(groups, "verify", counted)
    rng = random.Random(7)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(60)]
    data = []
    for d in range(160):
        w = list(base)
        for k in rng.sample(range(60), 3 + d % 2):
            w[k] = f"n{rng.randrange(10**6)}"
        data.append((d, " ".join(w)))
    _, removed = linedup.line_decisions(spark.createDataFrame(data, "doc_id long, text string"))
    _, gone = removed_lines(data)
    assert {r["doc_id"] for r in removed.collect()} == set(gone)
    assert sum(compared) <= 8 * len(data)


def test_parities_refuse_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(80):
        near = rng.integers(0, 1 << 40, rng.integers(1, 900), dtype=np.uint64)
        sets += [near, np.append(near[: int(len(near) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 40, 3, dtype=np.uint64))]
    values, of = groups._distinct(np.concatenate(sets), np.array([len(x) for x in sets]))
    n = np.bincount(of)
    odd = groups.parities(values, of, len(sets)).view(np.uint64)
    common = groups._common(values, of, len(sets))
    a, b = np.triu_indices(len(sets), 1)
    assert (common[a, b] == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]).all()
    ok = groups.possible(80, 100, n[a], odd[a], n[b], odd[b])
    link = 100 * common[a, b] >= 80 * (n[a] + n[b] - common[a, b])
    assert link.any() and ok[link].all() and not ok.all()
