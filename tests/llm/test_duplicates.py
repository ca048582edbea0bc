"""Near duplicates, similar lines and repeated strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagegrain.llm import groups, linedup, neardup, suffixes
from tests_llm_rows import LOWER, ROWS, WORD, rows

BLANKS = " \t\n\r\x0b\x0c"


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(sets, num, den):
    """Least key of each key's component."""
    parent, seen = {k: k for k in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        common = Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(k)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    return {k: find(k) for k in sets}


def test_near_duplicates_query(spark, sf_dir, texts):
    sets = {d: shingles(t) for d, t in texts}
    comp = linked(sets, 85, 100)
    want = [(d, len(s), comp[d], comp[d] == d) for d, s in sets.items()]
    assert rows(neardup.op7_minmax_near_duplicates(spark, sf_dir)) == sorted(want, key=str)


def test_near_group_without_its_base(spark):
    """Variants of one text that isn't there: links between variants must be found without a common leader."""
    rng = random.Random(4)
    base = [f"word{rng.randrange(500)}" for _ in range(150)]
    data = []
    for d in range(120):
        w = list(base)
        for _ in range(1 + d % 3):
            w[rng.randrange(150)] = f"new{rng.random()}"
        data.append((d, " ".join(w)))
    data += [(d + 200, data[d % 7][1]) for d in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in data}
    comp = linked(sets, 85, 100)
    assert rows(neardup.near_duplicates(df)) == sorted(((d, len(s), comp[d], comp[d] == d) for d, s in sets.items()), key=str)


def test_near_duplicates_odd_rows(odd, none):
    got = rows(neardup.near_duplicates(odd, num=80))
    assert len(got) == len(ROWS)
    comp = {(d, n): c for d, n, c, _ in got}
    assert comp[(4, 1)] == 3 and comp[(3, 1)] == 3  # equal but for capitals
    assert comp[(None, len(shingles(ROWS[0][1])))] is None
    assert all(comp[(d, 0)] == d for d in (0, 1, 2))
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 540)]
    parent = {}
    for _ in range(60):
        for a, b in edges:
            m = min(parent.get(a, a), parent.get(b, b))
            parent[a] = parent[b] = m
    want = sorted((k, v) for k, v in parent.items() if k != v)
    got = groups.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == want


def lines_of(data):
    places, count = defaultdict(list), Counter()
    for d, t in data:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(BLANKS)
            if line:
                places[line].append((d, k))
                count[d] += 1
    return places, count


def removed_lines(data):
    places, count = lines_of(data)
    comp = linked({x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in sorted(places)}, 80, 100)
    members = defaultdict(list)
    for line, at in places.items():
        members[comp[line]] += at
    gone = defaultdict(list)
    for at in members.values():
        for d, k in sorted(at)[1:]:
            gone[d].append(k)
    return count, gone


def test_line_query(spark, sf_dir, texts):
    count, gone = removed_lines(texts)
    want = [(d, count[d], len(gone[d]), sorted(gone[d])) for d, _ in texts]
    assert rows(linedup.op10_fuzzy_line_dedup(spark, sf_dir)) == sorted(want, key=str)


def test_lines_odd_rows(spark, odd, none):
    out = linedup.dedupe_lines(odd)
    assert out.columns == odd.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(0, None), (1, ""), (2, " \n\t ")} <= got
    assert (5, ROWS[6][1].split("\n")[0] + "\n") in got  # the first of equal lines stays
    assert linedup.dedupe_lines(none).count() == 0
    data = [(1, "same line of text here\nown one\n\nsame line of text here "), (2, "\tsame line of text here\r"), (3, "own two")]
    out = linedup.dedupe_lines(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(out) == [(1, "same line of text here\nown one\n"), (3, "own two")]


def by_hand(data, length):
    seen, out = set(), []
    for d, t in sorted(data):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            gone[k : k + length] |= w in seen
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4_000, 2])
def test_repeated_strings(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab \né") for _ in range(rng.randint(20, 260))) for _ in range(30)]
    data = [(d, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for d in range(80)]
    data += [(200, None), (201, ""), (202, "a" * 500), (203, "a" * 1000), (204, parts[0]), (205, parts[0] * 3)]
    got = suffixes.dedupe(spark.createDataFrame(data, "doc_id long, text string")).drop("kept")
    assert sorted(map(tuple, got.collect())) == by_hand(data, 100)


def test_strings_odd_rows(odd, none):
    got = Counter(tuple(r)[:3] for r in suffixes.dedupe(odd).drop("kept").collect())
    assert sum(got.values()) == len(ROWS)
    assert got[(0, 0, 0)] == got[(1, 0, 0)] == 1
    assert got[(6, 700, 699)] == 1  # only the first window of equal letters is new
    assert suffixes.dedupe(none).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    for t in range(60):
        n = int(rng.integers(1, 50))
        data = rng.integers(0, 2, (n, 40)).astype(np.uint8)
        data[:, : t % 38] = data[0, : t % 38]
        group = np.sort(rng.integers(0, 3, n))
        for shallow in (8, 16, 64):
            order, common = suffixes.suffix_order(group, data, shallow)
            keys = [(group[k], data[k].tobytes()) for k in order]
            assert keys == sorted(keys)
            for j in range(1, n):
                if keys[j][0] != keys[j - 1][0]:
                    assert common[j] == -1
                else:
                    same = np.frombuffer(keys[j][1], np.uint8) == np.frombuffer(keys[j - 1][1], np.uint8)
                    assert common[j] == (40 if same.all() else int(np.argmin(same)))
