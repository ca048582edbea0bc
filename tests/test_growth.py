"""Work that must not grow with the square of a group, and digests against plain loops."""

from pagegrain.operators import agreement as A
from pagegrain.operators import graph as G


def joined_rows(df):
    """Rows that the joins of a query's executed plan put out, by the joins' own counters."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(node.plan())
        if "Join" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return out


def test_repeated_mentions_meet_once(spark):
    said = [(f"Document_{i % 3}", "erwaehnt", "Place_1", "uri") for i in range(300)]
    typed = [("Place_1", "entityType", "place", "literal")] * 300
    triples = spark.createDataFrame(said + typed, "subject string, predicate string, object string, object_type string")
    df = G.document_entities(triples)
    assert sorted(map(tuple, df.select("document", "entity", "type").collect())) == [(f"Document_{i}", "Place_1", "place") for i in range(3)]
    assert joined_rows(df) == [3]


def test_differences_are_summed_in_their_piece(spark):
    a, b = "abcdefghij" * 40 + "xyz", "abcdefghiJ" * 40
    df = spark.createDataFrame([(1, a, b), (2, "", "q"), (3, "a", "a"), (4, None, None)], "k int, a string, b string")
    got = {r["k"]: tuple(r)[1:] for r in A.difference_summary(df, ["k"], "a", "b").collect()}
    want = {}
    for r in A.text_differences(df, ["k"], "a", "b").collect():
        want.setdefault(r["k"], []).append(r)
    assert got == {
        k: (
            len(d), sum(r["position"] for r in d), sum(r["char2"] == "" for r in d), sum(r["char1"] == "" for r in d),
            min(r["context"] for r in d), max(r["context"] for r in d),
        )
        for k, d in want.items()
    }
    assert got[1][:4] == (43, sum(range(9, 400, 10)) + 400 + 401 + 402, 3, 0)
    # the aggregate gets a row per piece, not one per position: nothing is exploded after the pieces
    text = A.difference_summary(df, ["k"], "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate ") == 2


def test_suspect_letters_are_summed_in_their_piece(spark):
    df = spark.createDataFrame([(1, "Cool 0il " * 50), (1, "|"), (2, "xyz"), (3, None), (1, "")], "k int, t string")
    got = {(r["k"], r["char"]): tuple(r)[2:] for r in A.confusion_summary(df, ["k"], "t").collect()}
    want = {}
    for r in A.confusion_hits(df, ["k"], "t").collect():
        want.setdefault((r["k"], r["char"], r["alternatives"]), []).append(r)
    assert got == {
        (k, c): (a, len(d), sum(r["position"] for r in d), min(r["context"] for r in d)) for (k, c, a), d in want.items()
    }
    assert got[1, "o"][1] == 100
    # a row per letter and piece is sorted, not one per position
    text = A.confusion_summary(df, ["k"], "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in text and text.count("Generate ") == 3


def shuffled_rows(df):
    """Rows that each exchange of a query's executed plan wrote."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(node.plan())
        if kind == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return out


def test_native_text_is_shuffled_by_text_not_by_seed(spark, monkeypatch):
    lines = [(p, i, f"line {i * 7919 % 1000:03d} of page {p:02d} says {i * p:05d} things in {i * i:06d} words") for p in range(8) for i in range(40)]
    native = spark.createDataFrame(
        [(p, "\n".join(t for q, _, t in lines if q == p)) for p in range(8)], "page_id long, native_text string"
    )
    rows = [(p, i, t if i % 3 == 0 else t.replace("s", "z") if i % 3 == 1 else t + " x") for p, i, t in lines]
    rows += [(p, 100 + k, t) for p in range(8) for k, t in enumerate(["of", "page 9", "qq", "", None])] + [(None, 0, "line"), (99, 0, "line 000")]
    boxes = spark.createDataFrame(rows, "page_id long, box_index long, text string")
    # no join of so few rows is broadcast here, as those of a large table aren't
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = A.matches_native(boxes, native)
        got = {(r["page_id"], r["box_index"]): r["matches_native"] for r in df.collect()}
        # about 700 seeds and 20 chunks of a page stay in the task that has the page (4,568 rows were shuffled before)
        assert max(shuffled_rows(df)) <= len(rows)
        # pages too large for one task give the same
        monkeypatch.setattr(A, "LARGE", 1000)
        large = A.matches_native(boxes, native)
        assert {(r["page_id"], r["box_index"]): r["matches_native"] for r in large.collect()} == got
        assert max(shuffled_rows(large)) > len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows)
    assert all(got[p, i] == (i % 3 != 1) for p in range(8) for i in range(40))
    assert [got[1, 100 + k] for k in range(5)] == [True, False, False, False, False]
    assert not got[None, 0] and not got[99, 0]
