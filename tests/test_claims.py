from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import outcome as o
from quillcheck.functions import stats
from quillcheck.operators.claims import Check, confusion, run_checks, verdicts, widen


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("op", ["<=", ">=", "=", "!=", "<", ">"])
def test_comparisons_are_three_valued(spark, op):
    values = [None, 1.0, 1.5, 2.0]
    plain = {
        "<=": lambda a, b, t: a <= b + t, ">=": lambda a, b, t: a >= b - t, "=": lambda a, b, t: abs(a - b) <= t, "!=": lambda a, b, t: abs(a - b) > t,
        "<": lambda a, b, t: a < b, ">": lambda a, b, t: a > b,
    }[op]
    rows = spark.createDataFrame([(a, b) for a, b in itertools.product(values, values)], "a double, b double")
    for tol in (0, 0.5):
        for r in rows.select("a", "b", o.compare(op, "a", "b", tol).alias("x"), o.outcome(o.compare(op, "a", "b", tol)).alias("o")).collect():
            want = None if r.a is None or r.b is None else plain(r.a, r.b, tol)
            assert r.x == want
            assert r.o == {None: o.OPEN, True: o.PASS, False: o.FAIL}[want]


def test_sets_presence_and_similarity(spark):
    rows = spark.createDataFrame([("a", ["a", "b"]), ("c", ["a"]), (None, ["a"]), ("a", None), ("a", [])], "v string, l array<string>")
    got = rows.select(
        o.compare("IN", "v", "l").alias("i"), o.compare("NOT_IN", "v", "l").alias("n"), o.compare("EMPTY", "l").alias("e"),
        o.compare("NOT_EMPTY", "l").alias("f"), o.compare("EXISTS", "v").alias("x"),
    ).collect()
    assert [r.i for r in got] == [True, False, None, None, False]
    assert [r.n for r in got] == [False, True, None, None, True]
    assert [r.e for r in got] == [False, False, False, None, True]
    assert [r.f for r in got] == [True, True, True, None, False]
    assert [r.x for r in got] == [True, True, False, True, True]
    assert one(spark, o.jaccard(F.lit("Red steel bolt"), F.lit("steel BOLT, blue"))) == 0.5
    assert one(spark, o.jaccard(F.lit("a b"), F.lit(""))) == 0.0


def test_round4_goes_up_on_halves(spark):
    assert one(spark, o.round4(F.lit(-2.00005))) == -2.0 and one(spark, o.round4(F.lit(2.00005))) == 2.0001


def test_aggregates_are_whole_or_unknown(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False), ("b", None, None), ("b", 1.0, False), ("c", 1.0, True), ("c", None, None)], "k string, v double, bad boolean")
    got = {r.k: (r.s, r.b) for r in rows.groupBy("k").agg(o.whole(F.sum("v"), "v").alias("s"), o.any_line("bad").alias("b")).collect()}
    assert got == {"a": (3.0, True), "b": (None, None), "c": (None, True)}
    empty = rows.where("false").agg(o.whole(F.sum("v"), "v").alias("s"), o.any_line("bad").alias("b")).first()
    assert empty.s is None and empty.b is None


CHECKS = [
    Check("SUM", "=", "a", "b"),
    Check("WHEN", ">=", "a", "0", applies="flag"),
    Check("GUARD", ">=", "a", "0", open_if=("b > 5",)),
    Check("READ", "<=", "a", "100", fail_if_null=("a",)),
    Check("FORM", "=", "a", forms=((("b",), "b"), (("c",), "c"))),
    Check("EXACT", "=", "a", "b", tol=0.1, exact=True),
    Check("ADVICE", "<", "a", "0", advisory=True),
]


def test_check_ladder(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 1.0, None, True), (2, 1.0, 2.0, None, False), (3, None, 2.0, None, None), (4, 1.0, None, 1.0, True), (5, 0.3, 0.4, None, True), (6, 1.0, 9.0, 0.0, True)],
        "id int, a double, b double, c double, flag boolean",
    )
    got = {(r.id, r.rule): r.outcome for r in run_checks(rows, ["id"], CHECKS).collect()}
    P, N, Q = o.PASS, o.FAIL, o.OPEN
    assert [got.get((k, "SUM")) for k in range(1, 7)] == [P, N, Q, Q, N, N]
    assert [got.get((k, "WHEN")) for k in range(1, 7)] == [P, None, Q, P, P, P]
    assert [got.get((k, "GUARD")) for k in range(1, 7)] == [P, P, Q, Q, P, Q]
    assert [got.get((k, "READ")) for k in range(1, 7)] == [P, P, N, P, P, P]
    assert [got.get((k, "FORM")) for k in range(1, 7)] == [P, N, Q, P, N, N]
    assert got[5, "EXACT"] == P  # 0.4 - 0.3 is a hair over 0.1 before rounding
    v = {r.id: r for r in verdicts(run_checks(rows, ["id"], CHECKS), ["id"]).collect()}
    assert v[1].outcome == P and v[2].outcome == N and v[3].outcome == N
    for r in v.values():
        assert r.n_total == r.n_pass + r.n_fail + r.n_open
        assert (r.outcome == N) == (r.n_fail > 0)
    only = {r.id: r for r in verdicts(run_checks(rows, ["id"], [CHECKS[1], CHECKS[2]]), ["id"], consistency=("WHEN",)).collect()}
    assert only[4].outcome == Q and only[1].outcome == P


def test_tolerance_band_and_gate(spark):
    rows = spark.createDataFrame([(1, 104.0, 100.0), (2, 190.0, 100.0), (3, 1.0, None)], "id int, a double, b double")
    claims = widen(run_checks(rows, ["id"], [Check("T", "=", "a", "b"), Check("P", ">=", "a", "0")]), 1.0, 0.05, 50.0)
    assert {(r.id, r.rule): r.outcome for r in claims.collect() if r.rule == "T"} == {(1, "T"): o.PASS, (2, "T"): o.FAIL, (3, "T"): o.OPEN}
    assert {r.id: r.gate for r in verdicts(claims, ["id"]).collect()} == {1: "PASS", 2: "FAIL", 3: "PASS-WITH-OPEN"}


def test_no_rows_no_claims(spark):
    rows = spark.createDataFrame([], "id int, a double, b double, c double, flag boolean")
    assert verdicts(run_checks(rows, ["id"], CHECKS), ["id"]).count() == 0
    assert confusion(run_checks(rows, ["id"], CHECKS), ["rule"], "outcome", F.lit(True)).count() == 0


def test_bounds(spark):
    for k, n in ((0, 10), (3, 40), (40, 40), (1, 1000)):
        p = stats.upper_rate(k, n)
        assert p == 1.0 if k == n else abs(stats.binomial_cdf(k, n, p) - 0.05) < 1e-9
        w = one(spark, stats.wilson(F.lit(k), F.lit(n)))
        assert k / n <= w <= 1
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))) is None
    assert abs(one(spark, stats.all_hold(F.lit(10), F.lit(4), F.lit(2))) - 4 / 10 * 3 / 9) < 1e-12
    assert one(spark, stats.all_hold(F.lit(10), F.lit(4), F.lit(0))) == 1.0
    assert one(spark, stats.clopper_pearson(F.lit(0), F.lit(59))) == pytest.approx(1 - 0.05 ** (1 / 59))
