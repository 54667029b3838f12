"""Matching, balances, invoices and mined rules on small made papers, against plain loops."""

from __future__ import annotations

from itertools import product
from math import comb

from pyspark.sql import functions as F

from quillcheck.operators import grammar, matching
from quillcheck.operators.grammar import Field
from quillcheck.sources import einvoice


def test_bill_lines_find_their_order_lines(spark):
    order = spark.createDataFrame([(1, "a", "X-1", 10.0, 4.0), (1, "b", "x-2", 5.0, None), (1, "c", "X-2 ", 5.0, None), (1, "d", None, None, None)], "doc int, line_id string, sku string, unit_price double, invoiced double")
    bill = [("1", "a", None), ("2", None, " x-1"), ("3", None, "X-2"), ("4", None, "X-9"), ("5", None, " "), ("6", "z", "X-1"), ("7", "d", None), ("8", "b", "X-1")]
    rows = [(1, n, line, sku, 3.0, 10.2) for n, line, sku in bill]
    bills = spark.createDataFrame(rows, "doc int, line string, line_id string, sku string, quantity double, unit_price double")
    found = matching.match_lines(bills, order)
    assert {r.line: (r.po_line, r.match) for r in found.collect()} == {
        "1": (None, "several bill lines"), "2": (None, "several bill lines"), "3": (None, "SKU on several order lines"), "4": (None, "SKU on no order line"),
        "5": (None, "no order line or SKU named"), "6": (None, "no such order line"), "7": ("d", "matched"), "8": ("b", "matched"),
    }
    one = matching.match_lines(bills.where("line in ('1', '8')"), order)
    receipts = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (1, "b", 2.0)], "doc int, line_id string, quantity double")
    claims = {r.line: (r.quantity_claim, r.price_claim, r.billed_to_date) for r in matching.line_claims(one, order, receipts).collect()}
    assert claims == {"1": ("PASS", "PASS", "INSUFFICIENT_DATA"), "8": ("FAIL", "FAIL", None)}
    assert matching.line_claims(matching.match_lines(bills.limit(0), order), order, receipts).count() == 0


def test_balances_count_what_may_be_on_the_order(spark):
    orders = spark.createDataFrame([("v", "PO-1", 100.0, "USD"), ("v", "PO 2", None, None), ("w", "PO-1", 100.0, None)], "vendor string, order_number string, order_total double, order_currency string")
    bills = [(1, "v", "po 1", "I1", 30.0, "USD"), (2, "v", "PO1", "I2", 60.0, "USD"), (3, "v", "po.2", "I3", 1.0, "USD"), (4, "w", "PO1", "J1", 95.0, "EUR"), (5, "v", "PO1", "I5", 30.0, "EUR"), (6, "u", "PO1", "K", 1.0, None)]
    bill = spark.createDataFrame(bills, "bill int, vendor string, order_number string, number string, amount double, currency string")

    def reasons(*booked):
        rows = spark.createDataFrame(booked, "vendor string, order_number string, number string, amount double, currency string, placeless boolean")
        return {r.bill: r.reason for r in matching.balance(bill, orders, rows).collect()}

    over, lost, loose, cur = "over the order", "booked rows that cannot be counted", "rows without an order may be on it", "currencies differ"
    assert set(reasons(("v", None, "X", 5.0, None, True)).values()) == {None}
    assert reasons(("v", "PO-1", "i1", 50.0, "USD", None)) == {1: None, 2: over, 3: None, 4: None, 5: cur, 6: None}
    assert reasons(("v", "PO-1", "X", 30.0, None, None), ("v", None, "Y", 20.0, "USD", None)) == {1: None, 2: loose, 3: "order total not known", 4: None, 5: cur, 6: None}
    assert reasons(("v", "PO-1", "X", 1.0, "EUR", None)) == {1: lost, 2: lost, 3: None, 4: None, 5: cur, 6: None}
    assert reasons(("w", None, "X", None, None, None)) == {1: None, 2: None, 3: None, 4: lost, 5: None, 6: None}
    orders = orders.union(orders).union(spark.createDataFrame([("w", "po 1", 90.0, None)], orders.schema))  # repeats alike, and with another total
    assert reasons(("v", "PO-1", "X", 60.0, "USD", None), ("w", "PO-1", "X", 1.0, None, None)) == {1: None, 2: over, 3: None, 4: "order stands with different totals", 5: cur, 6: None}


_PEPPOL = "<cbc:CustomizationID>urn:cen.eu:en16931:2017#compliant#urn:fdc:peppol.eu:2017:poacc:billing:3.0</cbc:CustomizationID>"


def _ubl(lines: str, head: str = _PEPPOL) -> str:
    return f'<x:Invoice xmlns:x="urn:i" xmlns:cac="a" xmlns:cbc="b">{head}<cbc:ID>7</cbc:ID><cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode>{lines}</x:Invoice>'


def _line(net: str, extra: str = "", currency: str = "EUR") -> str:
    return (
        f'<cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:InvoicedQuantity>6</cbc:InvoicedQuantity><cbc:LineExtensionAmount currencyID="{currency}">{net}</cbc:LineExtensionAmount>{extra}'
        "<cac:Price><cbc:PriceAmount>10</cbc:PriceAmount><cbc:BaseQuantity>2</cbc:BaseQuantity></cac:Price></cac:InvoiceLine>"
    )


def test_invoices_are_read_and_judged(spark):
    allowance = lambda sign, v: f"<cac:AllowanceCharge><cbc:ChargeIndicator>{sign}</cbc:ChargeIndicator><cbc:Amount>{v}</cbc:Amount></cac:AllowanceCharge>"
    docs = {
        "exact": _ubl(_line("30.00")), "slack": _ubl(_line("30.02") * 2), "off": _ubl(_line("30.00") + _line("30.0201")), "both": _ubl(_line("29", allowance("false", 3) + allowance("true", 2))),
        "unclear": _ubl(_line("30", allowance("no", 0))), "foreign": _ubl(_line("30", currency="USD")), "none": _ubl("", ""), "dtd": "<!DOCTYPE a>" + _ubl(_line("30")), "text": "no xml", "null": None,
        "ksef": "<Faktura><Fa><KodWaluty>PLN</KodWaluty><P_2>9</P_2><P_15>12.3</P_15><FaWiersz><P_8B>2</P_8B><P_9A>5</P_9A><P_10>1</P_10><P_11>9</P_11></FaWiersz></Fa></Faktura>",
    }
    rows = einvoice.read(spark.createDataFrame(list(docs.items()), "profile string, ID string").select(F.col("profile").alias("name"), "ID"), "ID", ["name"])
    told = {r.name: (r.profile, r.told) for r in rows.select("*", F.transform("lines", lambda x: einvoice.line_math(x)).alias("told")).collect()}
    o = "INSUFFICIENT_DATA"
    assert told == {
        "exact": ("peppol-bis3", ["PASS"]), "slack": ("peppol-bis3", ["PASS"] * 2), "off": ("peppol-bis3", ["PASS", "FAIL"]), "both": ("peppol-bis3", ["PASS"]), "unclear": ("peppol-bis3", [o]),
        "foreign": ("peppol-bis3", [o]), "none": (None, None), "dtd": (None, None), "text": (None, None), "null": (None, None), "ksef": ("ksef-fa3", ["PASS"]),
    }
    assert rows.where("name = 'ksef'").first().number == "9" and rows.where("name = 'dtd'").first().number is None


LINES = {"q": Field("qty", source="a"), "p": Field("money", "price", "a"), "r": Field("qty", source="b")}
FIELDS = {"total": Field("money", "total", "a"), "extra": Field("money", "extra"), "own": Field("id"), "ids": Field("ids")}


def _violations(doc, lines):
    """Rule and tolerance to whether the case violates it, by loops."""
    whole = lambda vs: None if not lines or any(v is None for v in vs) else sum(vs)
    both = lambda a, b, f: None if a is None or b is None else f(a, b)

    def any_of(f):
        told = [f(x) for x in lines]
        return True if True in told else None if not told or None in told else False

    worth = whole([both(x["q"], x["p"], lambda a, b: a * b) for x in lines])
    cited = doc["ids"] and {"".join(x.split()).upper() for x in doc["ids"]}
    out = {("L2 q = r", 0.0): any_of(lambda x: both(x["q"], x["r"], lambda a, b: abs(a - b) > 1e-9))}
    for x, y in (("q", "r"), ("r", "q")):
        out[f"L1 {x} <= {y}", 0.0] = any_of(lambda v: both(v[x], v[y], lambda a, b: a > b + 1e-9))
        for t in (0.0, 0.5):
            out[f"L3 {x} <= {y}*(1+t)", t] = any_of(lambda v: both(v[x], v[y], lambda a, b: a > b * (1 + t) + 1e-9))
    out["D total = sum(q*p)", 0.0] = both(doc["total"], worth, lambda a, b: abs(a - b) > 0.005)
    out["D total = sum(q*p) + extra", 0.0] = both(doc["total"], both(worth, doc["extra"], lambda a, b: a + b), lambda a, b: abs(a - b) > 0.005)
    out["D extra <= 0", 0.0] = both(doc["extra"], 0.005, lambda a, b: a > b)
    out["I1 ids cites exactly one id = own", 0.0] = both(cited, doc["own"], lambda a, b: a != {"".join(b.split()).upper()})
    out["C total <= c", 0.0] = both(doc["total"], 8.0, lambda a, b: a > b)
    return out


def _fates(cases, found, rate):
    """Fates by loops over the cases."""
    fate, explained = {}, {}
    for c in found:
        for t in c.grid:
            told = [(held, v[c.rule, t]) for held, v in cases if v[c.rule, t] is not None]
            k = [held for held, v in told if v]
            if k.count(False) <= int(rate * [h for h, _ in told].count(False) + 1e-9):
                break
        else:
            fate[c.rule] = "INCONSISTENT"
            continue
        n, holds, h = len(told), sum(held for held, _ in told), sum(k)
        chance = sum(comb(holds, i) * comb(n - holds, len(k) - i) for i in range(h, min(holds, len(k)) + 1) if len(k) - i >= 0) / comb(n, len(k)) if k else 1
        fate[c.rule] = "VOID" if not k else "BASE_RATE" if h < 5 or chance > 0.01 else "REDUNDANT"
        if fate[c.rule] == "REDUNDANT":
            explained[c.rule] = {i for i, (held, v) in enumerate(cases) if held and v[c.rule, t]}
    seen: set = set()
    for rule in sorted(explained, key=lambda r: -len(explained[r])):
        if len(explained[rule] - seen) >= 3:
            fate[rule], seen = "CANDLE", seen | explained[rule]
    return fate


def test_rules_are_enumerated_and_judged(spark):
    docs, lines, made = [], [], []
    for n, (r, total, extra, ids) in enumerate(product((2.0, 2.5, 4.0, None), (4.0, 9.0, None), (0.0, 1.0, None), (["A 1"], ["a1", "A1 "], ["b"], None))):
        own = [{"q": 2.0, "p": 2.0, "r": r}] + ([{"q": 0.0, "p": 1.0, "r": 1.0}] if n % 3 == 0 else [])
        own = [] if n % 17 == 0 else own
        doc = {"id": n, "total": total, "extra": extra, "own": "a1", "ids": ids, "held": total == 9.0 and n % 10 != 0 or ids == ["b"] and n % 4 == 0 or r == 4.0}
        docs.append(tuple(doc.values()))
        lines += [(n, x["q"], x["p"], x["r"]) for x in own]
        made.append((doc["held"], _violations(doc, own)))
    found = grammar.candidates(LINES, FIELDS, (0.0, 0.5), (("total", "<=", 8.0),))
    assert {(c.rule, t) for c in found for t in c.grid} == set(made[0][1])
    cases = spark.createDataFrame(docs, "id int, total double, extra double, own string, ids array<string>, held boolean")
    flagged = grammar.flags(cases, spark.createDataFrame(lines, "id int, q double, p double, r double"), "id", F.col("held"), found, LINES)
    counted = grammar.patterns(flagged)
    tallied = {(r.rule, r.t): (r.n, r.holds, r.k, r.k_holds, r.k_approved) for r in grammar.tallies(counted, found).collect()}
    for key, got in tallied.items():
        told = [(held, v[key]) for held, v in made if v[key] is not None]
        bad = [held for held, v in told if v]
        assert got == (len(told), sum(h for h, _ in told), len(bad), sum(bad), bad.count(False)), key
    fates = set()
    for rate in (0.0, 0.1, 0.4):
        got = {r.rule: r.fate for r in grammar.report(counted, found, rate).collect()}
        assert got == _fates(made, found, rate)
        fates |= set(got.values())
    assert {"INCONSISTENT", "CANDLE", "BASE_RATE"} <= fates
    assert grammar.report(grammar.patterns(flagged.limit(0)), found).where("fate <> 'VOID'").count() == 0


def test_learned_cuts_equal_loops(spark):
    import random

    from quillcheck.operators import mine

    rng = random.Random(6)
    rows = [(rng.choice([None, float("nan"), *range(12)]), rng.uniform(0, 1), 5.0, None, None) for _ in range(300)]
    rows = [(None if x is None else float(x), y, z, w, y > 0.6 if rng.random() > 0.1 else y < 0.3) for x, y, z, w, _ in rows]
    frame = spark.createDataFrame(rows, "x double, y double, z double, w double, held boolean")
    for rate in (0.0, 0.1, 1.0):
        got = {(r.field, r.op): r for r in mine.learned_cuts(frame, ["x", "y", "z", "w"], F.col("held"), rate).collect()}
        assert set(got) == {(f, op) for f in "xyz" for op in ("<=", ">=")}
        for n, field in enumerate("xyz"):
            own = [(r[n], r[4]) for r in rows if r[n] is not None and r[n] == r[n]]
            values, approved = sorted({v for v, _ in own}), sum(not h for _, h in own)
            for op in ("<=", ">="):
                best = None
                for lo, hi in zip(values, values[1:]):
                    bad = [h for v, h in own if (v > lo if op == "<=" else v <= lo)]
                    a, missed = bad.count(False), sum(h for _, h in own) - bad.count(True)
                    if a <= int(rate * approved + 1e-9) and (best is None or (a + missed, a) < best[:2]):
                        best = (a + missed, a, lo, hi)
                r = got[field, op]
                if best is None:
                    assert r.c is None and r.fate == ("VOID" if len(values) < 2 else "INCONSISTENT")
                else:
                    assert (r.approved, r.missed, r.lo, r.hi, r.c) == (best[1], best[0] - best[1], best[2], best[3], best[2] + (best[3] - best[2]) / 2)


def test_cover_by_rounds_equals_the_plain_one(spark):
    import random

    from quillcheck.operators import mine

    rng = random.Random(7)
    for least in (1, 3):
        for _ in range(3):
            patterns = {"".join(rng.choices("01?", k=7)): rng.randint(1, 4) for _ in range(12)}
            frame = spark.createDataFrame(list(patterns.items()), "flags string, cases int")
            held = {f"r{k}": {p for p in patterns if p[k] == "1"} for k in range(7)}
            want = mine.novelty(held, patterns, least)
            assert mine.cover(frame, [(r, k) for k, r in enumerate(held)], least) == want
    assert mine.cover(frame, [], 1) == [] and mine.cover(frame.limit(0), [("r0", 0)], 1) == []


def test_invoices_are_written_without_format_strings(spark):
    from quillcheck.plans import papers, registry  # noqa: F401

    plan = registry.QUERIES["standard_invoices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and plan.count("collect_list(") == 1
    texts = {"remark": "<!-- DOCTYPE -->" + _ubl(_line("30.00")), "element": "<!ELEMENT a>" + _ubl(_line("30")), "entity": _ubl(_line("30") + "<!ENTITY>")}
    rows = einvoice.read(spark.createDataFrame(list(texts.items()), "name string, x string"), "x", ["name"])
    assert {r.name: r.profile for r in rows.collect()} == {"remark": "peppol-bis3", "element": None, "entity": None}
