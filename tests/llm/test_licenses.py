"""License scans against plain searching, and planted notices."""

import re

import compare
from pagegrain.llm import licenses
from tests_llm_rows import LOWER, ROWS

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILL = " ".join(f"plain{k}" for k in range(60))


def base(text):
    w = WORDS.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), tuple(sorted({x for _, x in places}))


def scan(spark, rows):
    df = spark.createDataFrame(
        [(i, t, "a", 1, 2, "l", None) for i, t in rows],
        "doc_id long, text string, words string, template int, begin int, label string, th long",
    )
    return licenses.scan(df).collect()


def test_base_columns(spark):
    rows = [
        *ROWS, (20, "MIT License; the mit license MIT-LICENSE mit  license"), (21, "gnu gnu general public license license"),
        (22, "GNU GENERAL PUBLIC LICENSE\nApache.License cc/by CC BY cc by"), (23, "mit licensé mitKlicense K cc byé"),
        (24, "xmit license apache licenses gnu general public"), (25, "cc by"), (25, "cc by"), (25, "by cc by cc"), (None, "cc by"),
        (26, "apache license " * 20_000), (27, FILL + " apache license"),
    ]
    got = sorted(
        ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], tuple(r["base_labels"])) for r in scan(spark, rows)), key=str
    )
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)


def test_notices(spark):
    rows, want = [], {}
    for k, (label, text, keys) in enumerate(licenses.NOTICES):
        rows += [
            (10 * k, f"{FILL} {text}. {FILL}"),
            (10 * k + 1, f"// {text.upper().replace(' ', chr(10) + '// ')}"),
            (10 * k + 2, f"{FILL} {keys[0]} {FILL} {keys[1]}"),  # key phrases alone
            (10 * k + 3, " ".join(sorted(text.split()))),  # its words in another order
        ]
        want |= {10 * k: label, 10 * k + 1: label}
    got = {r["doc_id"]: r for r in scan(spark, rows)}
    for k, r in got.items():
        own = [x for x in r["labels"] if x.endswith("notice")]
        assert own == ([want[k]] if k in want else []), (k, own)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert {x["begin"] for x in got[0]["places"] if x["label"] == "mit-notice"} == {60}


def test_edited_notice(spark):
    _, text, _ = licenses.NOTICES[0]
    edited = text.replace("associated documentation files", 'associated documentation files (the "Software")')
    rows = scan(spark, [(1, edited), (2, text.replace("hereby granted", "granted"))])
    found, missing = sorted(rows, key=lambda r: r["doc_id"])
    assert "mit-notice" in found["labels"] and missing["labels"] == []


def test_weights_follow_the_corpus(spark):
    docs = spark.createDataFrame([(k, "gnu is here") for k in range(9)] + [(9, "public general license"), (10, None)], "doc_id long, text string")
    n, df = licenses.frequencies(docs, ["gnu", "general", "public", "license"])
    assert (n, df) == (10, {"gnu": 9, "general": 1, "public": 1, "license": 1})
    index, _ = licenses.postings(n, df, licenses.PHRASES, [])
    assert index[0][0] == "general" and index[0][5] == 1


def test_no_rows(spark):
    assert scan(spark, []) == []
    assert [(r["n_words"], r["labels"], r["score"]) for r in scan(spark, [(1, None), (2, "")])] == [(0, [], 0.0)] * 2


def test_query(spark, con, sf_dir, texts):
    assert compare.compare(spark, con, licenses.op12_license_scan, licenses.OP12_SQL, sf_dir) is None
    got = licenses.op12_license_scan(spark, sf_dir).collect()
    names = ("n_words", "n_base", "first_word", "last_word")
    assert {r["doc_id"]: (*(r[c] for c in names), r["base_labels"]) for r in got} == {
        i: (*base(t)[:4], ",".join(base(t)[4])) for i, t in texts
    }
