"""Bill lines on their orders with claims, in one step and in two, and how often papers are exchanged."""

from __future__ import annotations

import random

from quillcheck.operators import matching
from quillcheck.plans import papers, registry  # noqa: F401


def test_claims_in_one_step_equal_those_in_two(spark):
    rng = random.Random(8)
    docs = [None, *range(12)]
    order = {(d, i): (d, i, rng.choice([None, "x", " X", "y", "z"]), rng.choice([None, 2.0, 5.0]), rng.choice([None, 1.0])) for d in docs for i in [None, *rng.sample("abcd", 3)]}
    bills = [(rng.choice(docs), str(k), rng.choice([None, None, *"abcde"]), rng.choice([None, "", "X", "y ", "z", "w"]), float(rng.randint(1, 4)), rng.choice([None, 1.0, 2.04, 2.05, 6.0])) for k in range(200)]
    receipts = [(rng.choice(docs), rng.choice([None, *"abcde"]), rng.choice([None, 1.0, 2.0])) for _ in range(60)]
    order = spark.createDataFrame(list(order.values()), "doc int, line_id string, sku string, unit_price double, invoiced double")
    bills = spark.createDataFrame(bills, "doc int, line string, line_id string, sku string, quantity double, unit_price double")
    receipts = spark.createDataFrame(receipts, "doc int, line_id string, quantity double")
    want = {r.line: r.asDict() for r in matching.line_claims(matching.match_lines(bills, order), order, receipts).collect()}
    for frames in ((bills, order, receipts), [f.repartition("doc") for f in (bills, order, receipts)]):
        got = {r.line: r.asDict() for r in matching.matched_claims(*frames).collect()}
        names = ("doc", "line", "line_id", "sku", "po_line", "match", "quantity_claim", "price_claim", "billed_to_date")
        assert {k: [r[n] for n in names] for k, r in got.items()} == {k: [r[n] for n in names] for k, r in want.items()} and len(got) == 200
    by_loops = {}
    lines = [r for r in order.collect() if r.doc is not None]
    for b in bills.collect():
        own = [o.line_id for o in lines if o.doc == b.doc]
        same = [o.line_id for o in lines if o.doc == b.doc and b.sku and (o.sku or "").strip().upper() == b.sku.strip().upper()]
        by_loops[b.line] = b.doc, (b.line_id if b.line_id in own else None) if b.line_id is not None else same[0] if len(same) == 1 else None
    claimed = [c for c in by_loops.values() if c[1] is not None]
    assert {k: r["po_line"] for k, r in want.items()} == {k: c[1] if claimed.count(c) == 1 else None for k, c in by_loops.items()}
    assert len({r["match"] for r in want.values()}) == 6


def test_papers_of_an_order_are_exchanged_once_a_kind(spark):
    found = registry.QUERIES["structured_match"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
