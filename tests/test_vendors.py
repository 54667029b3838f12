from __future__ import annotations

from pyspark.sql import functions as F

from quillcheck.functions import vendors
from quillcheck.operators import duplicates

ALIKE = [
    ("summit electrical supply", "sumit electrical supply", "typo"), ("summit elec supply", "summit electrical supply", "abbreviation"),
    ("acme mfg", "acme manufacturing", "abbreviation"), ("pemberton lab gl", "pemberton lab glass", "abbreviation"), ("ses electrical", "summit electrical supply", "initials"),
    ("boa", "bank of america", "initials"), ("se supply", "summit electrical supply", "initials"), ("northfield handling", "northfield material handling", "words left out"),
    ("acme holdings dba summit supply", "summit supply", "trading name"), ("acme d b a sumit supply", "summit supply", "trading name"), ("harbor", "harbor freight", "words left out"),
]
APART = [("acme", "apex"), ("north supply", "south supply company of texas"), ("abc", "abd"), ("delta", "gamma rays"), ("acme inc", "acme llc"), ("", "acme"), ("dba", "acme dba")]


def reasons(spark, pairs):
    schema = "a string, b string"
    ab = {(r.a, r.b): r.reason for r in vendors.near_reasons(spark.createDataFrame(pairs, schema), "a", "b").collect()}
    ba = {(r.b, r.a): r.reason for r in vendors.near_reasons(spark.createDataFrame([(b, a) for a, b in pairs], schema), "a", "b").collect()}
    return [(ab[p], ba[p]) for p in pairs]


def test_names_look_alike_both_ways(spark):
    assert reasons(spark, [(a, b) for a, b, _ in ALIKE]) == [(why, why) for *_, why in ALIKE]


def test_names_are_apart(spark):
    assert reasons(spark, [*APART, ("ａcme inc", "Acme"), (None, "acme"), ("a", None)]) == [(None, None)] * (len(APART) + 3)


def test_typos_with_swaps_and_links(spark):
    pairs = [("hrabor freight", "harbor freight"), ("bank america", "bank of america"), ("boa trust", "bank of america trust"), ("n supply co", "north supply"), ("st marys svc", "saint marys services")]
    assert [x for x, _ in reasons(spark, pairs)] == ["typo", "words left out", "initials", "abbreviation", "abbreviation"]


def test_blank_values_match_nothing(spark):
    schema = "id int, number string, vendor string, tax string, vendor_id string, po string, total double"
    booked = [(1, " ", "Acme", None, None, None, 1.0), (2, "N2", "Acme", " ", None, None, None), (3, "N3", "Acme", None, "", None, None), (4, "N4", "Acme", None, None, " ", 5.0), (5, "N5", " ", None, None, None, None)]
    bills = [(1, "", "Acme", None, None, None, 1.0), (2, "N2", "Other", "", None, None, None), (3, "N3", "Other", None, " ", None, None), (4, "X", "Acme", None, None, "", 5.0), (5, "Ｎ５", "Else", None, None, None, None)]
    got = duplicates.duplicate_claims(spark.createDataFrame(bills, schema), spark.createDataFrame(booked, schema)).collect()
    assert {r.id: (r.outcome, r.tier) for r in got} == {1: ("PASS", None), 2: ("PASS", None), 3: ("PASS", None), 4: ("PASS", None), 5: ("FAIL", 1)}


def test_tiers(spark):
    schema = "id int, number string, vendor string, tax string, vendor_id string, po string, total double"
    booked = [
        (1, "INV-1", "Summit Supply", None, None, "P1", 10.0), (2, "INV-2", "Summit Supply, Inc.", None, None, None, None), (3, "INV-3", "Sumit Supply", None, None, None, None),
        (4, "INV-4", "Summit Supply", "DE 1", None, None, None), (5, "INV-5", "Other Firm", None, None, "P1", 5.0), (6, "INV-006", "Summit Supply", None, None, None, None),
        (7, "INV-7", None, None, None, None, None), (8, "INV-8", "Other Firm", None, None, None, 1.0), (9, "INV-9", "Other Firm", "de-9", None, None, None), (9, "INV-9", "Other Firm", "de-9", None, None, None),
    ]
    bill = lambda k, number, po=None, total=None, tax=None, vid=None, name="Summit Supply": (k, number, name, tax, vid, po, total)
    bills = [
        bill(1, "inv-1 "), bill(2, "INV-2"), bill(3, "INV-3"), bill(4, "INV-4", tax="FR1"), bill(5, "INV-5", po="P1"), bill(6, "INV-6"), bill(7, "INV-7"), bill(8, "INV-8", total=2.0),
        bill(9, "INV-9", tax="DE9"), bill(10, "new", po="P1", total=10.01), bill(11, "new", po="P1", total=11.0), bill(12, None, po=None), bill(13, "###"),
    ]
    got = {r.id: (r.outcome, r.tier, r.booked) for r in duplicates.duplicate_claims(spark.createDataFrame(bills, schema), spark.createDataFrame(booked, schema)).collect()}
    open_ = "INSUFFICIENT_DATA"
    assert got == {
        1: ("FAIL", 1, 1), 2: ("FAIL", 2, 2), 3: ("FAIL", 3, 3), 4: (open_, 4, 4), 5: (open_, 4, 5), 6: (open_, 5, 6), 7: ("FAIL", 1, 7), 8: ("PASS", None, None),
        9: ("FAIL", 1, 9), 10: (open_, 6, 1), 11: ("PASS", None, None), 12: ("PASS", None, None), 13: ("PASS", None, None),
    }
    none = duplicates.duplicate_claims(spark.createDataFrame(bills, schema), spark.createDataFrame([], schema))
    assert {r.outcome for r in none.collect()} == {"PASS"} and none.count() == 13


def test_loose_numbers(spark):
    rows = spark.createDataFrame([("SES-020417",), ("nm 84665",), ("000",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(vendors.loose_number(F.col("x"))).collect()] == ["SES20417", "NM84665", "0", "", None]


def _every_pair(spark, bills, booked):
    """The ladder by all pairs of a number, its loose reading, or an order and total."""
    b, h = (rows.select(*[F.col(c).alias(p + c) for c in rows.columns]) for rows, p in ((bills, "b"), (booked, "h")))
    pairs = b.crossJoin(h)
    names = vendors.near_reasons(pairs.select("bvendor", "hvendor").distinct().where("bvendor is not null and hvendor is not null"), "bvendor", "hvendor")
    pairs = pairs.join(names, ["bvendor", "hvendor"], "left")
    relation = F.coalesce(vendors.name_relation(F.col("hvendor"), F.col("bvendor"), F.col("reason")), F.lit("unknown"))
    match = vendors.vendor_match(relation, (F.col("htax"), F.col("btax")), (F.col("hvendor_id"), F.col("bvendor_id")))
    best = {r.id: None for r in bills.collect()}
    for r in pairs.select("bid", "hid", match.alias("m"), *[(F.col("b" + c) == F.col("h" + c)).alias(c) for c in ("number", "po")], (F.abs(F.col("btotal") - F.col("htotal")) <= 0.01).alias("total"), (vendors.loose_number("bnumber") == vendors.loose_number("hnumber")).alias("loose")).collect():
        one = r.m in ("same", "unknown", "variant", "near")
        rules = [r.number and r.m in ("same", "unknown"), r.number and r.m == "variant", r.number and r.m == "near", r.number and (r.m == "conflict" or (r.m == "different" and (r.po or r.total))), r.loose and not r.number and one, r.po and r.total and one]
        tier = next((k + 1 for k, rule in enumerate(rules) if rule), None)
        if tier and (best[r.bid] is None or (tier, r.hid, r.m) < best[r.bid]):
            best[r.bid] = (tier, r.hid, r.m)
    return best


def test_the_ladder_without_pairs_is_that_of_all_pairs(spark):
    names = [None, "Acme", "ACME, Inc.", "Summit Supply", "Sumimt Supply", "Summit Sply", "Acme Holdings dba Summit Supply", "Sumit Supply Co", "Harbor Freight", "Harbor", "Hrabor Freight", "Zeta Works", "HF Zeta"]
    pick = lambda xs, k, a, b: xs[(k * a + k // 7 + b) % len(xs)]
    row = lambda k, a: (k, pick(["N1", "N01", "n2", "N2", None], k, a, 0).upper() if pick(["N1", "N01", "n2", "N2", None], k, a, 0) else None, pick(names, k, a, 3), pick([None, None, "T1", "T2"], k, a + 2, 1), pick([None, "V1", "V2"], k, a, 2), pick([None, "P1", "P2", "P3"], k, a, 5), pick([None, 1.0, 1.01, 2.5], k, a + 1, 1))
    schema = "id int, number string, vendor string, tax string, vendor_id string, po string, total double"
    bills, booked = spark.createDataFrame([row(k, 5) for k in range(90)], schema), spark.createDataFrame([row(k, 11) for k in range(0, 120, 3)], schema)
    want = _every_pair(spark, bills, booked)
    got = {r.id: (r.tier, r.booked, r.match) if r.tier else None for r in duplicates.duplicate_claims(bills, booked, places=1).collect()}
    assert got == want and {x[0] for x in want.values() if x} >= {1, 2, 3, 4}


def test_bills_of_one_number_are_not_paired(spark, monkeypatch):
    counts, real = [], duplicates.near_reasons
    monkeypatch.setattr(duplicates, "near_reasons", lambda pairs, x, y: (counts.append(pairs.count()), real(pairs, x, y))[1])
    schema = "id int, number string, vendor string, tax string, vendor_id string, po string, total double"
    rows = lambda first, sign: spark.createDataFrame([(k, "N1", f"{sign * 3} {chr(97 + k % 26) * 4} {chr(97 + k // 26) * 5}", None, None, None, None) for k in range(first, first + 60)], schema)
    got = {r.id: r.booked for r in duplicates.duplicate_claims(rows(0, "u"), rows(0, "u")).collect()}
    assert got == {k: k for k in range(60)} and counts[0] <= 60
