from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcheck.functions import numbers, text
from quillcheck.operators import duplicates, graph, ledger, mine, reconcile, series, usage
from quillcheck.sources import population


def test_every_payment_and_record_has_one_class(spark):
    pay = spark.createDataFrame(
        [("a", 10.0, "USD", "2024-01-02"), ("b", 10.0, "USD", "2024-01-02"), ("c", 5.0, "USD", "2024-01-02"), ("c", 5.0, "USD", "2024-01-03"), (None, 1.0, "USD", "2024-01-01"),
         ("e", 9.0, "EUR", "2024-01-02"), ("f", 9.0, None, "2024-01-02"), ("g", 9.0, "USD", "2024-01-02"), ("h", None, "USD", "2024-01-02")],
        "key string, amount double, currency string, paid_at string",
    ).withColumn("paid_at", F.col("paid_at").cast("date"))
    book = spark.createDataFrame(
        [("a", 10.0, "USD", "2024-01-01", "PASS"), ("c", 10.0, "USD", "2024-01-01", "PASS"), ("d", 1.0, "USD", "2024-01-01", "PASS"), (None, 2.0, "USD", "2024-01-01", "PASS"),
         ("e", 9.0, "USD", "2024-01-01", "PASS"), ("f", 9.0, "USD", "2024-01-09", "PASS"), ("g", 1.0, "USD", "2024-01-09", "FAIL"), ("h", 4.0, "USD", "2024-01-01", "PASS")],
        "key string, amount double, currency string, decided_at string, outcome string",
    ).withColumn("decided_at", F.col("decided_at").cast("date"))
    got = {r.key or r.reason: r["class"] for r in reconcile.completeness(pay, book).collect()}
    assert got == {
        "a": "MATCHED", "b": "BYPASSED", "c": "AMBIGUOUS", "d": "ORPHAN", "NO_KEY": "BYPASSED", "UNKEYED": "ORPHAN", "e": "MISMATCHED",
        "f": "CHECKED_AFTER_PAYMENT", "g": "PAID_DESPITE_HOLD", "h": "MATCHED",
    }
    assert reconcile.completeness(pay.where("false"), book.where("false")).count() == 0


def test_first_failing_claim_decides(spark):
    claims = spark.createDataFrame(
        [(1, "x", "PASS"), (1, "y", "FAIL"), (2, "x", "INSUFFICIENT_DATA"), (2, "y", "FAIL"), (3, "x", "PASS"), (3, "y", "PASS"), (3, "other", "FAIL")], "id int, rule string, outcome string"
    )
    got = {r.id: (r.decision, r.because) for r in reconcile.first_failing(claims, ["id"], {"x": "HOLD", "y": "DISPUTE"}).collect()}
    assert got == {1: ("DISPUTE", "y"), 2: ("ASK", "x"), 3: ("APPROVE", None)}


def test_duplicates_name_the_first(spark):
    rows = spark.createDataFrame([(1, "INV-028417"), (2, "inv 28417"), (3, "INV-028417"), (4, "INV-28417-R2"), (5, "X-1"), (6, None), (7, None)], "id int, number string")
    rows = duplicates.written_alike(rows, "number")
    got = {r.id: (r.kind, r.earlier) for r in duplicates.nearest_earlier(rows, "id", "id", {"exact": ["number"], "formatting": ["tight"], "revision": ["base"]}).collect()}
    assert got == {1: (None, None), 2: ("formatting", 1), 3: ("exact", 1), 4: ("revision", 1), 5: (None, None), 6: (None, None), 7: (None, None)}


def _entries(spark, n=12):
    events = spark.createDataFrame([(k % 2, k, f"p{k}") for k in range(n)], "chain int, id int, payload string")
    return ledger.build_chains(events, "chain", ["id"], F.col("payload"))


def test_chains_link_and_break_where_touched(spark):
    entries = _entries(spark)
    head, want = "0" * 64, {}
    for seq, k in enumerate(range(0, 12, 2)):
        payload = hashlib.sha256(f"p{k}".encode()).hexdigest()
        head = hashlib.sha256(f"{seq}:{head}:{payload}".encode()).hexdigest()
        want[seq] = head
    assert {r.seq: r.entry_hash for r in entries.where("chain = 0").collect()} == want
    clean = ledger.verify_chains(entries, "chain", F.col("payload")).collect()
    assert all(r.first_break is None and r.n == 6 for r in clean)
    assert next(r.head for r in clean if r.chain == 0) == head
    touched = entries.withColumn("payload", F.when(F.col("id") == 6, "changed").otherwise(F.col("payload")))
    assert {r.chain: (r.first_break, r.reason) for r in ledger.verify_chains(touched, "chain", F.col("payload")).collect()} == {0: (3, "payload"), 1: (None, None)}
    lost = ledger.verify_chains(entries.where("id <> 4"), "chain").where("chain = 0").first()
    assert (lost.first_break, lost.reason) == (3, "seq")
    certified = ledger.verify_chains(touched, "chain", F.col("payload"), after=F.lit(3)).where("chain = 0").first()
    assert certified.first_break is None


def test_periods_never_drop_late_events(spark):
    rows = spark.createDataFrame(
        [(0, "2024-01-01 10:00"), (1, "2024-01-02 09:00"), (2, "2024-01-01 23:00"), (3, "2024-01-03 00:00")], "seq int, at string"
    ).select(F.lit(1).alias("c"), "seq", F.col("at").cast("timestamp").alias("at"))
    got = ledger.close_periods(ledger.chain_periods(rows, ["c"], "seq", "at", "day"), ["c"], "seq").orderBy("period").collect()
    assert [(str(r.period.date()), r.n, r.closed_by) for r in got] == [("2024-01-01", 1, 1), ("2024-01-02", 2, 3), ("2024-01-03", 1, None)]


def test_draws_nest_and_repeat(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("s"))
    draws = {rate: {r.id for r in ledger.draw(rows, ["s"], "id", "seed", rate).collect()} for rate in (0.01, 0.1, 0.1000001, 1.0)}
    assert draws[0.01] < draws[0.1] and len(draws[0.1]) == 200 and len(draws[1.0]) == 2000
    keys = {k: hashlib.sha256(f"seed:{'hot' if k < 1500 else 'cold'}:{k}".encode()).hexdigest() for k in range(2000)}
    want = set(sorted(range(1500), key=keys.__getitem__)[:150]) | set(sorted(range(1500, 2000), key=keys.__getitem__)[:50])
    assert draws[0.1] == want


def test_time_join_equals_all_pairs(spark):
    rng = random.Random(8)
    a, b = [[(k, rng.randint(0, 2), rng.uniform(0, 5000)) for k in range(80)] for _ in range(2)]
    left = spark.createDataFrame(a, "reply int, tokens int, s double")
    right = spark.createDataFrame(b, "row int, tokens int, s double")
    got = {(r.reply, r.row) for r in usage.by_time_and_tokens(left, right, ["tokens"], "s", 300).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 300}


def test_learned_cut_and_kth(spark):
    rng = random.Random(4)
    cases = [(rng.choice([-1, 1]) * rng.choice([0.2, 3.0, 50.0]) * rng.randint(1, 40), rng.random() < 0.4) for _ in range(400)]
    rows = spark.createDataFrame(cases, "x double, held boolean")
    got = mine.learned_cut(rows, "x", F.col("held"), 0.2).first()
    values = sorted({x for x, _ in cases})
    approved = sum(not h for _, h in cases)
    best = min(
        (sum(h for x, h in cases if x <= v) + above, above, v)
        for v in values[:-1]
        for above in [sum(not h for x, h in cases if x > v)]
        if above <= int(0.2 * approved)
    )
    assert (got.errors, got.approved_above) == best[:2]
    assert got.cut == pytest.approx((best[2] + values[values.index(best[2]) + 1]) / 2)
    ordered = sorted((x for x, _ in cases), reverse=True)
    assert mine.kth_largest(rows, "x", 0.25) == ordered[int(0.25 * 400)]
    assert mine.kth_largest(rows.where("false"), "x", 0.25) is None
    assert mine.upper_tail(10, 4, 2, 2) == pytest.approx(4 / 10 * 3 / 9) and mine.upper_tail(10, 4, 2, 0) == pytest.approx(1)
    assert mine.novelty({"a": {1, 2, 3}, "b": {2, 3}, "c": {3, 4}}, {k: 1 for k in range(5)}) == [("a", 3, 3), ("c", 2, 1)]
    rng = random.Random(3)
    for _ in range(50):
        cases = [{r for r in "abcde" if rng.random() < 0.4} for _ in range(30)]
        kinds = sorted({"".join(sorted(c)) for c in cases})
        held = {r: {k for k in kinds if r in k} for r in "abcde"}
        want, seen = [], set()
        by_case = {r: {i for i, c in enumerate(cases) if r in c} for r in "abcde"}
        for r in sorted(by_case, key=lambda r: -len(by_case[r])):
            if by_case[r] - seen:
                want.append((r, len(by_case[r]), len(by_case[r] - seen)))
                seen |= by_case[r]
        assert mine.novelty(held, {k: sum("".join(sorted(c)) == k for c in cases) for k in kinds}) == want


def test_fits_find_made_values(spark):
    x = np.geomspace(0.01, 100, 300)
    y = x / (1 - np.exp(-np.sqrt(x / 1.2)))
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 1.0, 1.0)], "k int, x double, y double")
    got = {r.k: r for r in series.relation_fit(rows, "k", "x", "y").collect()}
    assert got[1].scale == pytest.approx(1.2, rel=1e-2) and got[2].scale is None
    line = spark.createDataFrame([(1, float(a), 2.0 * a + 3) for a in range(20)], "k int, x double, y double")
    fit = series.orthogonal_fit(line, "k", "x", "y").first()
    assert (fit.slope, fit.intercept) == (pytest.approx(2), pytest.approx(3))
    curve = spark.createDataFrame([(1, float(r), v) for r, v in enumerate([10.0, 50.0, 90.0, 99.0, 100.0, 101.0])], "k int, r double, v double")
    assert series.flat_value(curve, ["k"], "r", "v").first().flat == pytest.approx(100)


def test_states_roll_up_a_graph(spark):
    nodes = spark.createDataFrame([(k, k in (4, 5)) for k in range(8)], "id int, own boolean")
    parents = spark.createDataFrame([(4, 1), (5, 1), (6, 2), (5, 2), (1, 0), (2, 0)], "child int, parent int")
    got = {r.id: (r.done, r.total, r.state) for r in graph.roll_up(nodes, parents).collect()}
    assert got[1] == (2, 2, "DONE") and got[2] == (1, 2, "PARTLY") and got[0] == (2, 3, "PARTLY") and got[7] == (0, 1, "OPEN")


def test_strict_json(spark):
    values = ['{"b":1.0,"a":[1,2]}', '{"a":1,"a":2}', '{"a":0.1234567890123456789}', '{"a":NaN}', "{", None, '{"a":1e400}', "[" * 300 + "]" * 300, '"é"', '{"a":9007199254740993}']
    rows = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    got = {r.id: r for r in population.canonical_json(rows, "t", ["id"]).collect()}
    assert got[0].canonical == '{"a":[1,2],"b":1}' and got[0].hash == hashlib.sha256(got[0].canonical.encode()).hexdigest()
    assert got[1].refused == "repeated key a" and "inexact" in got[2].refused and got[3].refused and got[4].refused == "not JSON"
    assert got[5].refused and got[6].refused and got[7].refused == "too deep" and got[8].canonical == '"é"' and "inexact" in got[9].refused


def test_readers_refuse_and_set_aside(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('id,name\n1,"a, ""b"""\n2,c\n')
    assert [r.name for r in population.read_csv(spark, str(tmp_path / "ok.csv"), ["id", "name"]).collect()] == ['a, "b"', "c"]
    (tmp_path / "bad.csv").write_text("id,name\n1,a\n2,b,c\n")
    with pytest.raises(Exception):
        population.read_csv(spark, str(tmp_path / "bad.csv"), ["id", "name"]).collect()
    (tmp_path / "x.jsonl").write_text('{"id":1}\nnope\n{"id":2}\n')
    rows, refused = population.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id int")
    assert [r.id for r in rows.collect()] == [1, 2] and [r.value for r in refused.collect()] == ["nope"]
    (tmp_path / "log").write_text('{"seq":0}\n{"se\n{"seq":1}\n{"seq":')
    events, bad = population.read_log(spark, str(tmp_path / "log"), "seq int")
    assert [r.seq for r in events.collect()] == [0, 1] and sorted(r.kind for r in bad.collect()) == ["CORRUPT", "TORN_TAIL"]
    population.write_log(events, str(tmp_path / "out"), "seq")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == [{"seq": 0}, {"seq": 1}]


def test_numbers_and_identifiers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    read = lambda x: one(numbers.amount(F.lit(x)))
    assert [float(read(x)) for x in ("$1,234.50", "(1.234,50)", "12", "-3.00")] == [1234.5, -1234.5, 12, -3]
    assert read("twelve") is None and read(None) is None
    assert one(numbers.rate(F.lit("12.5%"))) == 0.125 and one(numbers.rate(F.lit("0.2"))) == 0.2 and one(numbers.quantity(F.lit("3 x"))) == 3
    assert [one(text.tight_id(F.lit(x))) for x in ("inv-028417", "INV 28417", "12-345")] == ["INV|28417", "INV|28417", "12|345"]
    assert [one(text.identifier_key(F.lit(x))) for x in ("INV/2026/001", "a-1.b")] == ["INV2026-001", "A1B"]
    for name, want in {"Acme Co., Inc.": "acme", "Müller & Söhne GmbH": "müller and söhne", "O'Brien's L.L.P.": "obriens", "Inc.": "inc", "Co Ltd": "co", "日本 株式": "日本 株式"}.items():
        assert one(text.vendor_name(F.lit(name))) == want
    for x, y, n in (("ab", "ba", 1), ("", "abc", 3), ("abc", "", 3), ("ca", "abc", 3), ("kitten", "sitting", 3), ("", "", 0), ("abcd", "acbd", 1)):
        assert spark.range(1).select(F.lit(x).alias("x"), F.lit(y).alias("y")).select(text.edits("x", "y")).first()[0] == n
    assert one(text.quotable(F.lit("“Long–\n  word-\nbreak”"))) == '"long- wordbreak"'
    assert [float(one(numbers.minor_unit(F.lit(c)))) for c in ("JPY", "xaf", "Uyi", "kwd", "USD", "???")] == [1, 1, 1, 0.001, 0.01, 0.01]
