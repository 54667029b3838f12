"""The decision layer against hand-worked rows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from quillcheck.operators import decisions


def test_gate_labels_in_every_case(spark):
    cases = list(product(("PASS", "FAIL", "INSUFFICIENT_DATA"), (0, 1), (0, 2), (0, 3)))
    rows = spark.createDataFrame(cases, "v string, s int, k int, u int")
    got = {tuple(r)[:4]: r.label for r in rows.withColumn("label", decisions.gate_label(*(F.col(c) for c in "vsku"))).collect()}
    for v, s, k, u in cases:
        want = v if v == "FAIL" else "HELD-SUSPECT" if s else "OPEN" if k else "PASS-WITH-OPEN" if v == "PASS" and u else v
        assert got[v, s, k, u] == want


def test_tax(spark):
    cases = [
        (None, 0.1, 10.0, 1, None), (0.0, None, 0.0, 0, "no tax billed"), (-1.0, 0.1, 10.0, 1, "negative tax"), (1.0, None, 10.0, 1, "no tax terms"),
        (1.0, 0.0, 10.0, 1, "no tax due"), (1.03, 0.1, 10.0, 3, "as stated"), (1.04, 0.1, 10.0, 3, "off the stated rate"), (0.01, 0.1, 0.0, 0, "as stated"),
    ]
    rows = spark.createDataFrame(cases, "t double, r double, b double, n int, want string")
    for r in rows.select("want", decisions.tax_due(F.col("t"), F.col("r"), F.col("b"), F.col("n")).alias("c")).collect():
        assert (r.c and r.c.reason) == r.want
        assert r.c is None or r.c.outcome == {"no tax billed": "PASS", "as stated": "PASS", "no tax due": "FAIL"}.get(r.want, "INSUFFICIENT_DATA")


def test_policies(spark):
    tiers = [("a", 1, 59, 0.05), ("a", 2, 58, 0.05), ("a", 3, 300, 0.06), ("b", 1, 10, 1.0), ("b", 2, 10, 0.0), ("c", 1, None, 0.5)]
    found = decisions.lint_tiers(spark.createDataFrame(tiers, "p string, o int, min_n int, max_error double"), "p", "o")
    assert {(r.p, r.o): r.findings for r in found.collect()} == {
        ("a", 1): "", ("a", 2): "min_n falls; min_n is inert", ("a", 3): "max_error rises", ("b", 1): "max_error out of range", ("b", 2): "max_error out of range", ("c", 1): "",
    }


def test_reviews_that_count(spark):
    T, N = True, False
    reviews = [
        ("w", T, N, T, 1, 2, N), ("w", T, N, T, 1, 2, T), ("w", N, N, T, 1, 2, T), ("w", T, N, N, 1, 2, T), ("w", T, N, T, 1, 1, T), ("w", T, N, T, None, 2, T),
        ("w", T, N, T, 1, None, N), ("w", N, N, T, 1, None, N), ("w", T, T, T, 1, 2, T), ("w", T, T, T, 1, 2, N), ("w", T, T, T, 1, 1, T), ("w", N, T, N, 1, 3, T), ("x", None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(reviews, "k string, drawn boolean, planted boolean, signed boolean, owner int, reviewer int, overturned boolean")
    got = {r.k: r for r in decisions.audit_reviews(frame, ["k"]).collect()}
    w = got["w"]
    assert (w.n_counted, w.n_not_drawn, w.n_unsigned, w.n_own_work, w.n_untested, w.n_overturned, w.n_tests, w.n_caught) == (2, 1, 1, 2, 1, 1, 2, 1)
    assert 0 < w.caught_at_least < 0.5 and got["x"].n_counted == 0 and got["x"].caught_at_least is None


def test_flags_and_bars(spark):
    rows = spark.createDataFrame([(1, "1", 2.0), (1, "4", 9.0), (1, "9", None), (1, "1", None), (2, "1", 1.0), (2, None, 5.0)], "k int, f string, v double")
    policy = {"compute": ("1", "2"), "strike": ("4",), "absent": ("9",)}
    got = rows.groupBy("k").agg(*[c.alias(n) for n, c in decisions.by_flag(F.col("f"), F.col("v"), policy).items()]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 1, 2, 2.0), (2, 1, 1, 0, 0, None)]
    bars = spark.createDataFrame([(1.0, 100.0), (9.0, 100.0), (0.0, 1.0), (1.0, None)], "t double, f double")
    assert [r[0] for r in bars.select(decisions.money_bar(F.col("t"), F.col("f"))).collect()] == [0.01, 0.05, None, None]
