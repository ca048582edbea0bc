"""Bucketed ordered computations against plain windows, with one hot group."""

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagegrain.operators import spread


@pytest.fixture(scope="module")
def hot(spark):
    """10,000 rows; group 0 holds four fifths of them."""
    i = F.col("id")
    return spark.range(10_000).select(
        F.when(i % 5 == 0, i % 7 + 1).otherwise(0).alias("g"),
        i.alias("k"),
        ((i * 7919) % 1013).alias("v"),
        (i % 3 == 0).alias("flag"),
    ).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_row_numbers(hot, ranges):
    got = spread.row_numbers(hot, ["g"], [F.col("k")], ranges=ranges)
    want = hot.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long"))
    assert rows(got.select("g", "k", "pos")) == rows(want.select("g", "k", "pos"))


def test_row_numbers_with_nulls(spark):
    data = [(g, k, i) for i, (g, k) in enumerate([(None, 3), (None, None), (1, None), (1, 70), (1, 2), (2, 5)])]
    df = spark.createDataFrame(data, "g long, k long, i long")
    got = spread.row_numbers(df, ["g"], [F.col("k")], ranges=4)
    assert {r["i"]: r["pos"] for r in got.collect()} == {0: 2, 1: 1, 2: 1, 3: 3, 4: 2, 5: 1}


def test_global_row_numbers(hot):
    got = spread.row_numbers(hot, [], [F.col("k")], start=0)
    assert rows(got.select("k", "pos")) == [(i, i) for i in range(10_000)]


def _sizes(df, cols):
    ranged = spread.with_ranges(df, [F.col(c) for c in cols])
    return [r["count"] for r in ranged.groupBy("_bucket").count().collect()]


def test_ranges_are_even_whatever_the_values(spark):
    i = F.col("id")
    cases = spark.range(50_000).select(
        (i * i * 1_000_003).alias("gaps"),  # ids far apart
        (i % 10 + 1).alias("page"),  # pages 1 to 10 of all documents
        F.floor(i / 10).alias("doc"),
        ((i * 48271) % 50_021 / 5_002_100).alias("small"),  # values in (0, 0.01]
        F.when(i % 3 == 0, 5).otherwise(i).alias("third"),  # a third of the rows in one place
    )
    for cols in (["gaps"], ["page", "doc"], ["small"]):
        sizes = _sizes(cases, cols)
        assert len(sizes) > 900 and max(sizes) < 50_000 / 64, cols
    sizes = sorted(_sizes(cases, ["third"]))
    assert len(sizes) > 900 and sizes[-2] < 50_000 / 64
    got = spread.row_numbers(cases, [], [F.col("page"), F.col("doc")])
    assert {(r["page"], r["doc"]): r["pos"] for r in got.select("page", "doc", "pos").collect()} == {
        (p + 1, d): p * 5_000 + d + 1 for p in range(10) for d in range(5_000)
    }


def test_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "g long, k long")
    assert spread.row_numbers(none, ["g"], [F.col("k")]).collect() == []
    assert spread.exact_median(none, ["g"], "k").collect() == []
    one = spark.createDataFrame([(None, None)], "g long, k long")
    assert [r["pos"] for r in spread.row_numbers(one, ["g"], [F.col("k")]).collect()] == [1]


def test_median_of_crowded_values(spark):
    i = F.col("id")
    df = spark.range(200_000).select(F.when(i % 4 == 0, i % 5).otherwise(-1).alias("g"), ((i * 48271) % 200_003 / 20_000_300).alias("x"))
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append(r["x"])
    got = {r["g"]: r["median"] for r in spread.exact_median(df, ["g"], "x").collect()}
    assert got == {g: statistics.median(v) for g, v in groups.items()}


@pytest.mark.parametrize("how", ["max", "sum"])
def test_running(hot, how):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    fn = {"max": F.max, "sum": F.sum}[how]
    value = F.when(F.col("v") > 900, F.col("v"))
    got = spread.running(hot, ["g"], "k", value, "r", how, width=128)
    want = hot.withColumn("r", fn(value).over(w))
    key = lambda t: (t[0], t[1])
    pick = lambda df: sorted(map(tuple, df.select("g", "k", "r").collect()), key=key)
    assert pick(got) == pick(want)


def test_neighbours(hot):
    ranked = spread.row_numbers(hot, ["g"], [F.col("k")])
    near = spread.with_neighbours(ranked, ["g"], "pos", reach=4, width=50)
    w = Window.partitionBy("g", "_bucket").orderBy("pos").rowsBetween(-4, 4)
    got = near.withColumn("s", F.sum("v").over(w)).where("_own").select("g", "k", "s")
    plain = Window.partitionBy("g").orderBy("k").rowsBetween(-4, 4)
    assert rows(got) == rows(hot.withColumn("s", F.sum("v").over(plain)).select("g", "k", "s"))


def test_exact_median(hot):
    signed = hot.withColumn("x", F.when(F.col("k") % 11 != 0, F.col("v") / 7 - 60))
    got = {r["g"]: r["median"] for r in spread.exact_median(signed, ["g"], "x").collect()}
    groups = {}
    for r in signed.where("x is not null").collect():
        groups.setdefault(r["g"], []).append(r["x"])
    assert got == pytest.approx({g: statistics.median(v) for g, v in groups.items()})


def test_ordered_concat(hot):
    text = hot.withColumn("t", F.col("k").cast("string"))
    got = {
        r["g"]: r["text"]
        for r in spread.ordered_concat(text, ["g"], ["k"], spread.int_bucket("k", 64), "t", "-").collect()
    }
    want = {}
    for g, k in rows(hot.select("g", "k")):
        want.setdefault(g, []).append(str(k))
    assert got == {g: "-".join(v) for g, v in want.items()}


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, 4, 99), (2, 1, 3)], "p int, t int, id int")
    got = rows(spread.latest(df, ["p"], [F.col("t"), F.col("id")]).select("p", "id"))
    assert got == [(1, 11), (2, 3)]
