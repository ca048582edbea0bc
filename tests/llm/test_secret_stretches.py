"""Random strings of letters only, and behind ordinary prefixes."""

import random
import string
import time

import numpy as np

from pagegrain.llm import secrets

WORDS = "read write table column index cluster partition schedule connection string account station number other".split()


def test_letters_and_prefixes(spark):
    rng = np.random.default_rng(3)
    letters, chars = np.array(list(string.ascii_letters)), np.array(list(string.ascii_letters + string.digits))

    def key(of, n):
        return "".join(rng.choice(of, n))

    def usual(n):
        return "".join(w.title() for w in rng.choice(WORDS, n))

    texts = [f"the {usual(3)} of {usual(4)} reads {' '.join(rng.choice(WORDS, 30))} token: {key(chars, 24)} end" for _ in range(400)]
    keys = [key(letters, 16) for _ in range(40)]
    keys += ["connection_string_account_number=" + key(chars, 20) for _ in range(40)]
    keys += ["com/other/station/schedule/read/" + key(chars, 24) for _ in range(40)]
    plain = ["connection_string_account_number=table_column", "com/other/station/schedule/read/table", "-" * 30, "=" * 20,
             "/a/b/c/d/e/f/g/h/i/j", usual(5)]
    first = len(texts)
    texts += [f"see {x} here" for x in [*keys, *plain]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(df).collect()}
    hit = [got[first + k] == f"random:4:{4 + len(x)}" for k, x in enumerate(keys)]
    assert [sum(hit[k : k + 40]) >= 39 for k in (0, 40, 80)] == [True] * 3
    assert [got[first + len(keys) + k] for k in range(len(plain))] == [""] * len(plain)
    assert not any("random" in got[k] for k in range(first))


def test_threshold_from_both_kinds(spark):
    texts = [f"usualidentifiers{'abcdefgh'[k % 8]} token: {k:016d}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full, unseen = secrets.train(df)
    limit = secrets.calibrate(df, unseen)
    assert secrets.ratio("usualidentifiersa", full) < limit < secrets.ratio("0000000000000077", full)
    assert limit <= secrets.THRESHOLD


def test_tokens_avoid_base_spans_as_pairwise_comparison_does():
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcXYZ019") for _ in range(rng.randint(10, 24))) for _ in range(12))
        taken = []
        for _ in range(rng.randint(0, 8)):
            start = rng.randrange(len(text))
            taken.append((start, start + rng.choice([1, 3, 30, 90]), rng.choice(["assign", "hex"])))
        want = [m.span() for m in secrets.TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in taken)]
        assert secrets.tokens(text, taken) == want


def test_long_log_of_digests_takes_linear_time():
    text = "".join(f"{k:032x} ok\n" for k in range(60_000))
    begin = time.monotonic()
    base = secrets.base_spans(text)
    assert len(base) == 60_000 and secrets.tokens(text, base) == []
    assert time.monotonic() - begin < 20  # comparing all pairs takes minutes
