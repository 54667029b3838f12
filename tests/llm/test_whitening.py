"""Whitening against numpy on the whole fit list."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillcheck.llm import whitening as wh


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, x string").repartition(parts)


def brute(rows, components=16):
    usable = [(k, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for k, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in usable}), dtype=object)
    n = len(fit)
    sums = fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return usable, n, sums, values[order], vectors[:, order].T, np.trace(cov)


@pytest.mark.parametrize("fan", [16, 2])
def test_equals_numpy(spark, monkeypatch, fan):
    monkeypatch.setattr(wh, "FAN", fan)
    monkeypatch.setattr(wh, "BLOCK", 200)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.2, 20) + rng.normal(size=20) * 50
    rows = [(k, base[k % 250].astype(np.float32).tolist()) for k in range(300)]
    bad = [(1, None), (2, []), (3, [None] * 20), (4, [float("nan")] * 20), (5, [float("inf")] + [0.0] * 19), (6, [1.0] * 7), (7, [3e30] * 20)]
    given = [(k, v, "own", "own") for k, v in rows + bad] + [(None, rows[0][1], None, None)]
    out = wh.whitened_embeddings(frame(spark, given, 7)).collect()
    usable, n, sums, values, vectors, trace = brute(rows)
    assert len(out) == 301 * 16 and {r.n for r in out} == {n}
    found = {}
    for r in out:
        found.setdefault((r.vec_id, r.component), []).append(r)
    own = dict(usable)
    for (k, c), rs in found.items():
        x = own[0 if k is None else k]
        assert rs[0].deviation == sum((n * a - b) ** 2 for a, b in zip(x, sums))
        want = float(((np.array([n * a - b for a, b in zip(x, sums)], float) / n) @ vectors[c - 1]) / math.sqrt(values[c - 1]))
        assert abs(abs(rs[0].whitened) - abs(want)) < 1e-8
        assert rs[0].explained == pytest.approx(values[c - 1] / trace, rel=1e-9)
    assert max(r.identity_error for r in out) < 1e-9
    one = [r.whitened for r in out if r.component == 3 and r.vec_id is not None]
    signs = {np.sign(found[k, 3][0].whitened * ((np.array([n * a - b for a, b in zip(own[k], sums)], float) / n) @ vectors[2])) for k in range(5)}
    assert len(one) == 300 and len(signs) == 1


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (90, 6)) + 1_000_000
    parts = [wh.summary(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 50), (50, 90))]
    total = parts[0]
    for p in parts[1:]:
        total = wh.merge(total, p)
    centred = x - x.mean(axis=0)
    assert total[0] == 90 and total[1] == x.sum(axis=0).tolist()
    assert np.allclose(total[2].T @ total[2], centred.T @ centred, rtol=1e-12)


def test_edges(spark):
    assert wh.whitened_embeddings(frame(spark, [(1, None, "", "")])).count() == 0
    same = wh.whitened_embeddings(frame(spark, [(k, [1.0, 2.0], "", "") for k in range(4)])).collect()
    assert len(same) == 8 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}
    line = wh.whitened_embeddings(frame(spark, [(k, [float(k), 1.0], "", "") for k in range(4)])).collect()
    assert {r.whitened is None for r in line if r.component == 2} == {True}
    assert max(r.identity_error for r in line) < 1e-12


def test_numbers_that_no_long_holds():
    model = wh.Whitener(wh.summary(np.array([[0, 0], [4, 2]])), 2)
    model.n, model.sums = 3, [1 << 62, 5]
    centred = model.centred(np.array([[1 << 60, 3]]))
    assert centred.tolist() == [[3 * (1 << 60) - (1 << 62), 4]] and wh.deviations(centred) == [None]
