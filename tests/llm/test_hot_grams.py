"""Grams with very many surroundings: a few rows per context, and no repeat is lost."""

import random

import pytest

from pagegrain.llm import suffixes
from test_duplicates import by_hand


@pytest.mark.parametrize("most", [8, 60])
def test_hot_grams_make_few_rows(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    made, mapped = [], type(spark.range(1)).mapInArrow

    def counted(self, func, schema, *args, **options):
        out = mapped(self, func, schema, *args, **options)
        if "ctx" in self.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = word(180)
    data = [(d, word(rng.randint(0, 160)) + passage[rng.randint(0, 60) :] + word(rng.randint(0, 160))) for d in range(150)]
    # parts of the passage shorter than a window between other texts, and at the ends of documents
    data += [(d, word(90) + passage[20 : 20 + d % 90 + 30] + word(90)) for d in range(200, 290)]
    data += [(d, passage[d % 80 :]) for d in range(300, 340)] + [(d, passage[: 100 + d % 70]) for d in range(340, 380)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    contexts = suffixes._anchor_rows(df.selectExpr("doc_id did", "text"), 100).count()
    got = suffixes.dedupe(df).drop("kept")
    assert sorted(map(tuple, got.collect())) == by_hand(data, 100)
    assert max(made) <= 6 * contexts
