from __future__ import annotations

import random
from types import SimpleNamespace

from quillcheck.plans import texts


def _edits(x: str, y: str) -> int:
    d = {(i, 0): i for i in range(len(x) + 1)} | {(0, j): j for j in range(len(y) + 1)}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(x), len(y)]


def test_near_names_equal_all_pairs(spark):
    rng = random.Random(5)
    bases = ["abc", "abcdef", "supplier 000000123", "a name of thirty one character", "a name of thirty two characters x", "co", "inco rp"]
    rows = []
    for k in range(140):
        name = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(name) + 1)
            if rng.random() < 0.3:
                name[at : at + 2] = name[at : at + 2][::-1]
            else:
                name[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "7"])
        rows.append((k, k % 2, "".join(name).strip()))
    rows += [(900, None, "abcdef"), (901, 1, None)]
    table = spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_name string")
    names = {r.s_suppkey: r.x for r in table.select("s_suppkey", texts.text.vendor_name("s_name").alias("x")).collect()}
    allowed = lambda n: 0 if n < 6 else 1 if n < 16 else 2 if n < 32 else 3
    want = set()
    for a, n, _ in rows:
        for b, m, _ in rows:
            if a < b and n == m and n is not None and names[a] is not None and names[b] is not None:
                d = _edits(names[a], names[b])
                if d <= allowed(max(len(names[a]), len(names[b]))):
                    want.add((a, b, d))
    got = [tuple(r) for r in texts.near_names(SimpleNamespace(supplier=table)).select("a", "b", "edits").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {d for _, _, d in want} == {0, 1, 2, 3}


def test_distances_of_many_pairs_at_once(spark):
    rng = random.Random(2)
    say = lambda: "".join(rng.choices("abc", k=rng.choice([0, 1, 3, 6, 9, 50])))
    pairs = [(say(), say()) for _ in range(600)] + [("acme", "acme"), ("", "")]
    assert all(_edits(x, y) == _edits(*texts.text._core(x, y)) for x, y in pairs)
    short = [p for p in pairs if max(map(len, p)) < 20]
    assert texts.text._distances(*map(list, zip(*short))).tolist() == [_edits(*p) for p in short]
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "x string, y string").coalesce(1)
    assert [r[0] for r in rows.select(texts.text.edits("x", "y")).collect()] == [*(_edits(*p) for p in pairs), None, None]
