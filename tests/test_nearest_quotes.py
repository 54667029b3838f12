"""Longest runs of quotations against plain loops."""

from __future__ import annotations

import random

from quillcheck.operators import quotes


def longest(words: list[str], quoted: list[str], size: int):
    best = None
    for q in range(len(quoted)):
        for p in range(len(words)):
            n = 0
            while q + n < len(quoted) and p + n < len(words) and quoted[q + n] == words[p + n]:
                n += 1
            if n >= size and (best is None or n > best[0]):
                best = (n, q + 1, p + 1)
    return best


def test_runs_equal_loops(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(k, say(rng.randint(0, 40))) for k in range(25)] + [(100, None), (101, ""), (102, "A “b”\n c-\nd  a b"), (103, "a b c a b c a b c a b c")]
    asked = [(k, say(rng.randint(0, 12))) for k in range(12)] + [(50, None), (51, 'a "b" cd a'), (52, "a b c a b c")]
    for size in (3, 5):
        found = quotes.longest_runs(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(asked, "q int, text string"), "d", "q", size=size)
        got = {(r.d, r.q): (r.run, r.quoted_at, r.place) for r in found.collect()}
        clean = lambda x: x.lower().replace("-\n", "").replace("“", '"').replace("”", '"').split()
        want = {(d, q): longest(clean(x), clean(y), size) for d, x in docs for q, y in asked if x and y}
        assert got == {k: v for k, v in want.items() if v} and (size == 5 or (102, 51) in got)
