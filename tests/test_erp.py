"""Exports of three layouts and of none, by hand."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quillcheck.sources import erp

HEAD = {k: "1" for k in ("invoice_number", "date", "total", "po", "item", "quantity", "rate", "amount")}


def line(layout, **values):
    return {erp.LAYOUTS[layout][k]: v for k, v in (HEAD | values).items()}


def test_layouts_and_bills(spark):
    rows = [
        ("a", 1, line("generic", invoice_number="7", vendor="Acme", date="2024-02-01", total="1,050.50", amount="1,000", status="PAID")),
        ("a", 2, line("generic", invoice_number="7", vendor="Acme", date="2024-02-01", total="1,050.50", amount="50.50")),
        ("a", 3, line("generic", invoice_number="7", vendor="ACME", date="2024-02-01", amount="x")), ("a", 4, line("generic", invoice_number=" ", date="2024-02-01")),
        ("b", 1, line("netsuite", ref="R1", invoice_number="9", date="02/30/2024", po="Purchase Order #55", status="Rejected") | {"Freight": "3"}),
        ("c", 1, line("xero", invoice_number="8", date="2024-02-03T00:00:00", tax="4")), ("d", 1, {"Currency": "USD", "Status": "x"}), ("e", 1, {"colour": "red"}), ("f", 1, {"invoice_number": "1", "po": "2"}),
        ("g", 1, None), ("h", 1, {}), (None, 1, line("xero", invoice_number="5", date="2024-02-03")),
    ]
    frame = spark.createDataFrame(rows, "file string, row int, cells map<string,string>")
    got = {r.file: r for r in erp.layout_of(frame, "file", "row", "cells").collect()}
    assert {k: (r.layout, r.refused) for k, r in got.items()} == {
        "a": ("generic", None), "b": ("netsuite", None), "c": ("xero", None), "d": (None, "ambiguous"), "e": (None, "no layout"), "f": ("generic", "missing columns"),
        "g": (None, "no layout"), "h": (None, "no layout"), None: ("xero", None),
    }
    assert got["b"].unmapped == ["Freight"] and got["f"].missing == ["amount", "date", "item", "quantity", "rate", "total"]
    lines = erp.bill_lines(frame, "file", "row", "cells")
    by = {(r.file, r.row): r for r in lines.collect()}
    assert {k: r.problem for k, r in by.items() if r.problem} == {("a", 3): "unreadable amount", ("a", 4): "no bill", ("b", 1): "unreadable date"}
    assert (by["b", 1].po, by["b", 1].decision, by["a", 1].decision, by["c", 1].tax, by["c", 1].date) == ("55", "hold", "pay", 4.0, datetime.date(2024, 2, 3))
    found = {(r.file, r.ref): (r.total, r.n_lines, r.lines_sum, r.n_problems) for r in erp.bills(lines, "file", "row").collect()}
    assert found == {
        ("a", "7|2024-02-01|Acme"): (1050.5, 2, 1050.5, 0), ("a", "7|2024-02-01|ACME"): (1.0, 1, None, 1), ("b", "R1"): (1.0, 1, 1.0, 1),
        ("c", "8|2024-02-03T00:00:00|"): (1.0, 1, 1.0, 0), (None, "5|2024-02-03|"): (1.0, 1, 1.0, 0),
    }
    assert erp.layout_of(frame.where(F.lit(False)), "file", "row", "cells").count() == 0


def test_lines_are_not_sorted_to_find_headers(spark):
    frame = spark.createDataFrame([("a", 2, line("generic", total="7")), ("a", 1, line("generic", total="5")), ("a", 3, line("generic"))], "file string, row int, cells map<string,string>")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    heads, found = erp.layout_of(frame, "file", "row", "cells"), erp.bills(erp.bill_lines(frame, "file", "row", "cells"), "file", "row")
    first = lambda text: [x for x in text.splitlines() if "Aggregate(" in x][-1]  # noqa: E731  the one that sees the rows
    assert "HashAggregate" in first(plan(heads)) and "partial_min(row" in first(plan(heads))
    assert any("HashAggregate" in x and "partial_count(1)" in x for x in plan(found).splitlines())
    assert [(r.total, r.n_lines, r.lines_sum) for r in found.collect()] == [(5.0, 3, 3.0)]
