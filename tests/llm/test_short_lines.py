"""Short lines of which one character differs, against brute force."""

import random
from collections import defaultdict

from pagegrain.llm import linedup
from test_duplicates import linked


def grams(line, k):
    return {line[j : j + k] for j in range(max(1, len(line) - k + 1))}


def test_short_lines_with_one_change(spark):
    rng = random.Random(11)
    lines = []
    for n in (*range(20, 100, 2), 39, 48, 77, 78, 79, 98, 99, 120):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
        line = f"x{line}y"
        at = n // 2
        lines += [line, line[:at] + "#" + line[at + 1 :]]
    lines += ["=" * 30, "=" * 120, "short", "shorx"]
    data = [(d, line) for d, line in enumerate(lines)]
    _, removed = linedup.line_decisions(spark.createDataFrame(data, "doc_id long, text string"))
    got = {r["doc_id"] for r in removed.collect()}
    long = linked({d: grams(x, 8) for d, x in data}, 80, 100)
    short = linked({d: grams(x, 4) for d, x in data if len(x) < 99}, 80, 100)
    members = defaultdict(set)
    for d, _ in data:
        members[min(long[d], short.get(d, d))].add(d)
    want = {d for m in members.values() for d in m if d != min(m)}
    assert got == want
    twins = {d for d in range(1, len(lines) - 4, 2) if len(lines[d]) >= 39}
    assert twins <= got


def test_bands_miss_little():
    import inspect

    options = {k: p.default for k, p in inspect.signature(linedup.line_decisions).parameters.items()}
    assert (1 - 0.8 ** options["rows"]) ** options["bands"] < 1e-4 / 5
