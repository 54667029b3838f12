"""Letters, values in texts, sentences around a place and fingerprints against plain versions."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quillcheck.functions import numbers
from quillcheck.operators import ledger, markup

LETTER = """  1. Bolt | M6 | qty 1,200 | unit USD 3.50
2. Nut|qty 2|unit EUR 1,000.25
3. Pin | qty two | unit USD 1
x 4. No | qty 1 | unit USD 1
5. Tax: 9% | qty 1.5 | unit USD 2
6. Bad | qty 1.2.3 | unit USD 2"""


def test_lines_of_orders_and_receipts(spark):
    mails = spark.createDataFrame([(1, LETTER), (2, ""), (3, None), (4, "1. A | received 3\n 2.B|received 1,000 \n3. C | received"), (5, "99999999999. A | received 3")], "id int, t string")
    got = [tuple(r) for r in markup.order_lines(mails, ["id"], "t").orderBy("id", "line").collect()]
    assert [(i, n, x, None if q is None else float(q), None if u is None else float(u)) for i, n, x, q, u in got] == [(1, 1, "Bolt | M6", 1200.0, 3.5), (1, 2, "Nut", 2.0, 1000.25), (1, 5, "Tax: 9%", 1.5, 2.0), (1, 6, "Bad", None, 2.0)]
    got = [tuple(r) for r in markup.receipt_lines(mails, ["id"], "t").orderBy("id", "line").collect()]
    assert [(i, n, x, float(q)) for i, n, x, q in got] == [(4, 1, "A", 3.0), (4, 2, "B", 1000.0), (5, None, "A", 3.0)]


def test_terms(spark):
    cases = [
        ("PO-12 | Vendor: A | Freight: Not allowed\nTax: 8.25%", ("PO-12", False, 0.0825)), ("PO-12 Vendor\nFREIGHT: billable | Sales tax rate: exempt", (None, True, 0.0)), ("Tax: 101%\nfreight: as agreed", (None, None, None)),
        ("1. Tax: 5% | qty 1 | unit USD 1\nTax: none", (None, None, 0.0)), ("Tax: about 5%\nTax: 7%", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)),
    ]
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, t string").orderBy("n")
    got = rows.select(*[c.alias(k) for k, c in markup.order_terms(F.col("t")).items()]).collect()
    assert [tuple(r) for r in got] == [want for _, want in cases]


def test_values_stand_by_themselves(spark):
    cases = [
        ("pay $1,500.00.", 1500, "1,500.00"), ("pay 1500, now", 1500, "1500"), ("no 11500 or 15001 or 1500.5", 1500, None), ("1500", 1500, "1500"), (".1500.", 1500, "1500"), ("a1500b", 1500, "1500"),
        ("1,1500", 1500, None), ("", 1500, None), (None, 1500, None), ("1500", None, None),
    ]
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, t string, v int, want string")
    for r in rows.withColumn("got", numbers.written_as("t", F.col("v"))).collect():
        assert r.got == r.want, r


def plain_fingerprint(rows, bits):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [(k, sha(x)) for k, x in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for _ in range(3):
        slices = {}
        for k, h in sorted(level, key=order):
            slices.setdefault(None if k is None else k >> bits, []).append(h)
        level = [(k, sha("".join(h))) for k, h in slices.items()]
    return sha("".join(h for _, h in sorted(level, key=order)))


def test_fingerprints(spark):
    rng = random.Random(4)
    rows = [(k, f"r{rng.random()}") for k in rng.sample(range(-50, 300), 120)] + [(None, "n"), (7, "a"), (7, "b")]
    make = lambda x: ledger.fingerprint(spark.createDataFrame(x, "k int, v string"), "k", F.col("v"), bits=2).first()
    found = make(rows)
    assert (found.n, found.hash) == (len(rows), plain_fingerprint(rows, 2))
    assert make(rows[::-1]).hash == found.hash and make(rows[:-1]).hash != found.hash
    assert tuple(make([])) == (0, hashlib.sha256(b"").hexdigest())


def test_cells_are_cut_once(spark):
    mails = spark.createDataFrame([("1. A | qty 1 | unit USD 2",)], "t string")
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan(markup.order_lines(mails, [], "t")).count("split(") == 2  # lines, and the cells of a line
    assert plan(mails.select(markup.order_terms(F.col("t"))["tax"])).count("split(") <= 4


def test_receipts_meet_their_orders_lines(spark):
    mails = [
        (1, "1. a | qty 2 | unit USD 3.00\n2. b | qty 1,000 | unit USD 1\n3. c | qty 1", "2. b | received 400\n2. b | received 500\n1. a | got 2"), (2, "7. x | qty 1 | unit EUR 2", None), (3, None, "1. a | received 1"),
        (4, "99999999999. y | qty 1 | unit EUR 2\n5. z | qty 4 | unit EUR 2", "99999999999. y | received 1\n5. z | received 4"), (5, "", ""),
    ]
    found = markup.lines_received(spark.createDataFrame(mails, "id int, o string, r string"), "id", "o", "r")
    got = {(r.id, r.line): (r.qty, r.unit, r.received) for r in found.collect()}
    assert got == {(1, 1): (2, 3, None), (1, 2): (1000, 1, 900), (2, 7): (1, 2, None), (4, None): (1, 2, None), (4, 5): (4, 2, 4)}


def test_letters_are_written_and_read_once(spark):
    from quillcheck.plans import letters, registry  # noqa: F401

    plan = registry.QUERIES["letters_matched"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Aggregate [") == 3 and "Join LeftOuter" not in plan
