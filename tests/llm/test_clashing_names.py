"""Stages over documents whose other columns have the names used inside, and texts that collide under sums of powers."""

from pyspark.sql import functions as F

from pagegrain.llm import decontaminate, linedup, neardup, rules


def test_columns_come_back_as_they_were(spark):
    words = " ".join(f"word{k}" for k in range(40))
    data = [(1, f"{words} one"), (2, f"{words} two"), (3, "a clean text of its own with some more words to be long enough here"), (4, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    names = ["__doc", "__th", "__gone", "__doc_", "th", "gone", "comp", "key"]
    docs = docs.withColumns({n: F.col("doc_id") * 10 + k for k, n in enumerate(names)})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    for out, ids in (
        (rules.keep_good(docs, labels), {1, 2, 3}),
        (linedup.dedupe_lines(docs), {1, 3, 4}),
        (neardup.keep_one(docs), {1, 3, 4}),
        (decontaminate.remove_contaminated(docs, bench), {3, 4}),
    ):
        assert out.columns == docs.columns
        got = out.collect()
        assert {r["doc_id"] for r in got} == ids
        assert all(r[n] == r["doc_id"] * 10 + k for r in got for k, n in enumerate(names))


def _word(size, flip):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(size))


def test_complementary_texts_stay_apart(spark):
    for size in (1024, 4096):
        data = [(1, _word(size, 0)), (2, _word(size, 1)), (3, _word(size, 0) + "\n" + _word(size, 1))]
        docs = spark.createDataFrame(data, "doc_id long, text string")
        near = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs.filter("doc_id < 3")).collect()}
        assert near == {1: 1, 2: 2}
        counts = {r["doc_id"]: r["n_dup_lines"] for r in rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
        assert counts == {1: 0, 2: 0, 3: 0}
