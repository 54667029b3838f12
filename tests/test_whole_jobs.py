"""Flat prices and evidence lines against plain Python."""

from __future__ import annotations

import random

from quillcheck.operators import binding, series


def test_evidence_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("ab"), " ".join(rng.sample(["red", "blue", "ring", "bolt", "plate", "old", "hot", "x1y", "zed", "cap"], rng.randint(0, 4)))) for k in range(30)]
    rows += [(100, "lone", "red ring"), (101, None, "red"), (102, "b", None)]
    got = {r.line: (r.evidence, r.score) for r in binding.best_by_words(spark.createDataFrame(rows, "line int, g string, t string"), "g", "line", "t", 0.25).collect()}
    want = {}
    for k, g, x in rows:
        a = set((x or "").split())
        scores = {m: len(a & b) / min(len(a), len(b)) if a and b else 0 for m, h, y in rows if h == g and h is not None and m != k for b in [set((y or "").split())]}
        if scores:
            top = [m for m, s in scores.items() if s == max(scores.values())]
            want[k] = (top[0], max(scores.values())) if len(top) == 1 and max(scores.values()) >= 0.25 else (None, None)
    assert got == want and any(e is not None for e, _ in want.values())


def test_flat_values_are_streamed(spark):
    rows = [(k % 2 or None, k, 100.0 if k > 15_000 else 500.0) for k in range(30_000)] + [(7, 1, None), (7, 0, 1.0), (8, 1, 2.0)]
    flat = series.flat_value(spark.createDataFrame(rows, "k int, o int, v double"), ["k"], "o", "v")
    assert "collect_list" not in flat._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.flat, r.n_used) for r in flat.collect()}
    assert got == {None: (100.0, 7499), 1: (100.0, 7500), 7: (None, 0), 8: (None, 1)}
