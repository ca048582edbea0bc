"""Band keys of lines: few rows are shuffled, and lines on both sides of the bounds between signatures meet."""

import random

from pagegrain.llm import linedup
from test_duplicates import removed_lines


def test_keys_are_packed(spark, monkeypatch):
    frame, shuffled = type(spark.range(1)), []

    def counting(name):
        plain = getattr(frame, name)

        def counted(self, *args):
            shuffled.append(self.count())
            return plain(self, *args)

        monkeypatch.setattr(frame, name, counted)

    counting("repartition")
    counting("repartitionByRange")
    rng = random.Random(3)
    data = []
    for d in range(1_500):
        n = rng.randint(99, 250)
        line = "".join(rng.choice("abcdefghijklmnop éüжш€" if d % 3 else "abcdefgh ijkl") for _ in range(n))
        data.append((2 * d, f"x{line}y"))
        if d % 4 == 0:
            # changes at the end and inside, near the threshold; repeats alter no set
            cut = line[: int(n * rng.uniform(0.82, 1))]
            at = n // 3
            data.append((2 * d + 1, f"x{cut if d % 8 else line[:at] + '#' + line[at + 1 :]}y"))
    data += [(5_001, "ab" * 60), (5_002, "ab" * 400), (5_003, "\x00" * 2), (5_004, "\x00" * 3), (5_005, "жж"), (5_006, "\x16\x16")]
    _, removed = linedup.line_decisions(spark.createDataFrame(data, "doc_id long, text string").repartition(2))
    got = {r["doc_id"] for r in removed.collect()}
    _, gone = removed_lines(data)
    assert got ^ set(gone) == set() and len(got) > 200
    assert max(shuffled) <= 3 * len(data)
