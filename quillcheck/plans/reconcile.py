"""Queries on reconciliation, matching, duplicates and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from ..functions.outcome import FAIL, PASS, outcome
from ..operators import duplicates, quotes, reconcile
from ..operators.claims import Check, run_checks
from .registry import Tables, query

_SIDES = """
WITH pay AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey + 1 ELSE o_orderkey END END AS key,
    o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN o_orderkey % 40 = 3 THEN 'EUR' ELSE 'USD' END AS currency, o_orderdate::DATE AS paid_at
  FROM orders WHERE o_orderkey % 11 <> 5),
book AS (SELECT CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderkey END AS key, (o_totalprice::DECIMAL(18,2) + CASE WHEN o_orderkey % 17 = 4 THEN 5 ELSE 0 END)::DECIMAL(18,2) AS amount,
    CASE WHEN o_orderkey % 60 = 7 THEN NULL ELSE 'USD' END AS currency, o_orderdate::DATE + CASE WHEN o_orderkey % 23 = 9 THEN 3 ELSE 0 END AS decided_at,
    CASE WHEN o_orderstatus = 'P' THEN 'FAIL' ELSE 'PASS' END AS outcome
  FROM orders WHERE o_orderkey % 13 <> 6),
l AS (SELECT key, count(*) AS np, sum(amount) AS paid, min(currency) AS pc, min(paid_at) AS pa FROM pay WHERE key IS NOT NULL GROUP BY key),
r AS (SELECT key, count(*) AS nr, sum(amount) AS booked, min(currency) AS bc, min(decided_at) AS da, min(outcome) AS outcome FROM book WHERE key IS NOT NULL GROUP BY key),
j AS (SELECT coalesce(l.key, r.key) AS key, coalesce(np, 0) AS n_payments, coalesce(nr, 0) AS n_records, paid, booked, coalesce(pc, bc) AS currency, pc, bc, pa, da, outcome
  FROM l FULL OUTER JOIN r ON l.key = r.key),
c AS (
  SELECT key, CASE WHEN n_records = 0 THEN 'BYPASSED' WHEN n_payments = 0 THEN 'ORPHAN' WHEN n_payments > 1 OR n_records > 1 THEN 'AMBIGUOUS' WHEN outcome = 'FAIL' THEN 'PAID_DESPITE_HOLD'
      WHEN abs(paid - booked) > 0.01 OR coalesce(pc <> bc, false) THEN 'MISMATCHED' WHEN da - pa > 0 THEN 'CHECKED_AFTER_PAYMENT' ELSE 'MATCHED' END AS class,
    CASE WHEN n_records = 0 OR n_payments = 0 OR (n_payments = 1 AND n_records = 1) THEN NULL WHEN n_payments = 1 THEN 'one payment, several records'
      WHEN n_records = 1 THEN 'several payments, one record' ELSE 'several of both' END AS reason, n_payments, n_records, paid, booked, currency FROM j
  UNION ALL SELECT key, 'BYPASSED', 'NO_KEY', 1, 0, amount, NULL, currency FROM pay WHERE key IS NULL
  UNION ALL SELECT key, 'ORPHAN', 'UNKEYED', 0, 1, NULL, amount, currency FROM book WHERE key IS NULL)
"""


def _sides(t: Tables) -> DataFrame:
    """A register of payments and a book of decisions made from orders, each with its own gaps and mistakes."""
    k = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    day = F.col("o_orderdate").cast("date")
    pay_key = F.when(k % 97 != 0, F.when(k % 50 == 1, k + 1).otherwise(k))
    pay = t.orders.where(k % 11 != 5).select(
        pay_key.alias("key"), amount.alias("amount"), F.when(k % 40 == 3, "EUR").otherwise("USD").alias("currency"), day.alias("paid_at")
    )
    book = t.orders.where(k % 13 != 6).select(
        F.when(k % 89 != 0, k).alias("key"), (amount + F.when(k % 17 == 4, 5).otherwise(0)).cast("decimal(18,2)").alias("amount"),
        F.when(k % 60 != 7, "USD").alias("currency"), F.date_add(day, F.when(k % 23 == 9, 3).otherwise(0)).alias("decided_at"),
        F.when(F.col("o_orderstatus") == "P", FAIL).otherwise(PASS).alias("outcome"),
    )
    return reconcile.completeness(pay, book)


@query(_SIDES + "SELECT key, class, reason, n_payments, n_records, paid::DOUBLE AS paid, booked::DOUBLE AS booked, currency FROM c")
def reconcile_classes(t: Tables) -> DataFrame:
    """Every payment and record in exactly one class."""
    double = {c: F.col(c).cast("double") for c in ("paid", "booked")}
    return _sides(t).withColumns(double)


@query(_SIDES + "SELECT class, coalesce(currency, 'UNSPECIFIED') AS currency, count(*) AS n, sum(paid)::DOUBLE AS paid, sum(booked)::DOUBLE AS booked FROM c GROUP BY ALL")
def reconcile_totals(t: Tables) -> DataFrame:
    """Rows and exact totals by class and currency."""
    currency = F.coalesce("currency", F.lit("UNSPECIFIED")).alias("currency")
    return _sides(t).groupBy("class", currency).agg(F.count("*").alias("n"), F.sum("paid").cast("double").alias("paid"), F.sum("booked").cast("double").alias("booked"))


@query(
    """SELECT o_orderkey, CASE WHEN g IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(o_totalprice - g) <= greatest(1.0, 0.5 * greatest(abs(o_totalprice), abs(g))) THEN 'PASS' ELSE 'FAIL' END AS total_near,
  CASE WHEN f IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(epoch(f - o_orderdate) / 86400) <= 2000 THEN 'PASS' ELSE 'FAIL' END AS ships_near
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS g, min(l_shipdate) AS f FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
)
def coherence_checks(t: Tables) -> DataFrame:
    """Orders against their shipping papers: amounts within half, first shipment within 2,000 days."""
    papers = t.lineitem.where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("gross"), F.min("l_shipdate").alias("first_shipped")
    )
    seconds = "(unix_micros(cast(first_shipped as timestamp)) - unix_micros(cast(o_orderdate as timestamp))) / 86400000000"
    checks = {"total_near": ("o_totalprice", "gross", 1.0, 0.5), "ships_near": (seconds, "0.0 * gross", 2000.0, 0.0)}
    rows = reconcile.coherence(t.orders, papers, F.col("l_orderkey") == F.col("o_orderkey"), checks)
    return rows.select("o_orderkey", "total_near", "ships_near")


_MATCH = """
WITH po AS (SELECT l_partkey AS item, l_suppkey AS vendor, max(l_extendedprice / l_quantity) AS unit, sum(l_quantity) AS ordered FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
rc AS (SELECT l_partkey AS item, l_suppkey AS vendor, sum(l_quantity) AS received FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
bill AS (SELECT l_orderkey, l_linenumber, l_partkey AS item, l_suppkey AS vendor, l_quantity AS q, l_extendedprice / l_quantity AS u, l_extendedprice AS amount FROM lineitem WHERE l_linestatus = 'O'),
j AS (SELECT bill.*, unit, ordered, received FROM bill LEFT JOIN po USING (item, vendor) LEFT JOIN rc USING (item, vendor)),
o AS (SELECT l_orderkey, 'vendor' AS rule, CASE WHEN unit IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS outcome FROM j
  UNION ALL SELECT l_orderkey, 'quantity', CASE WHEN received IS NULL THEN 'INSUFFICIENT_DATA' WHEN q <= received THEN 'PASS' ELSE 'FAIL' END FROM j
  UNION ALL SELECT l_orderkey, 'price', CASE WHEN unit IS NULL THEN 'INSUFFICIENT_DATA' WHEN u <= unit * 1.02 + 0.01 THEN 'PASS' ELSE 'FAIL' END FROM j
  UNION ALL SELECT l_orderkey, 'amount', CASE WHEN abs(amount - q * u) <= 0.01 THEN 'PASS' ELSE 'FAIL' END FROM j)
"""


def _matched(t: Tables) -> DataFrame:
    """Claims on open lines as bills, against shipped lines as orders and kept lines as receipts, by part and vendor."""
    at = [F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("vendor")]
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    orders = t.lineitem.where("l_linestatus = 'F'").groupBy(*at).agg(F.max(unit).alias("unit"), F.sum("l_quantity").alias("ordered"))
    receipts = t.lineitem.where("l_returnflag <> 'R'").groupBy(*at).agg(F.sum("l_quantity").alias("received"))
    bills = t.lineitem.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", *at, F.col("l_quantity").alias("q"), unit.alias("u"), F.col("l_extendedprice").alias("amount"))
    rows = bills.join(orders, ["item", "vendor"], "left").join(receipts, ["item", "vendor"], "left")
    checks = [
        Check("vendor", "EXISTS", "unit", unless_all=("unit",)), Check("quantity", "<=", "q", "received", tol=0),
        Check("price", "<=", "u", "unit * 1.02"), Check("amount", "=", "amount", "q * u"),
    ]
    return run_checks(rows, ["l_orderkey"], checks).select("l_orderkey", "rule", "outcome")


@query(_MATCH + "SELECT rule, outcome, count(*) AS n FROM o GROUP BY ALL")
def three_way_match(t: Tables) -> DataFrame:
    """Bills against orders and receipts, counted by rule and outcome."""
    return _matched(t).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


POLICY = {"vendor": "ROUTE_TO_PURCHASING", "quantity": "HOLD_FOR_RECEIPT", "price": "DISPUTE_PRICE", "amount": "RETURN_TO_VENDOR"}


@query(
    _MATCH
    + """, p AS (SELECT l_orderkey, rule, outcome, CASE rule WHEN 'vendor' THEN 0 WHEN 'quantity' THEN 1 WHEN 'price' THEN 2 ELSE 3 END AS place FROM o),
f AS (SELECT l_orderkey, min_by({'r': rule, 'o': outcome}, place * 2 + CASE WHEN outcome = 'FAIL' THEN 0 ELSE 1 END) FILTER (WHERE outcome <> 'PASS') AS f FROM p GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN f IS NULL THEN 'APPROVE' WHEN f.o = 'INSUFFICIENT_DATA' THEN 'ASK' WHEN f.r = 'vendor' THEN 'ROUTE_TO_PURCHASING'
  WHEN f.r = 'quantity' THEN 'HOLD_FOR_RECEIPT' WHEN f.r = 'price' THEN 'DISPUTE_PRICE' ELSE 'RETURN_TO_VENDOR' END AS decision, f.r AS because FROM f"""
)
def payment_decision(t: Tables) -> DataFrame:
    """What to do with each bill: the first claim in policy order that does not pass decides."""
    return reconcile.first_failing(_matched(t), ["l_orderkey"], POLICY)


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice::DECIMAL(18,2) AS v FROM orders),
p AS (SELECT o_custkey, max(v) * 4 AS limit_ FROM b GROUP BY o_custkey),
r AS (SELECT o_custkey, o_orderkey, sum(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS to_date FROM b)
SELECT o_orderkey, to_date::DOUBLE AS billed_to_date, (limit_ - to_date)::DOUBLE AS balance, CASE WHEN to_date <= limit_ THEN 'PASS' ELSE 'FAIL' END AS outcome FROM r JOIN p USING (o_custkey)"""
)
def order_balance(t: Tables) -> DataFrame:
    """What has been billed on each blanket order so far against what was ordered (four times its largest bill)."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    so_far = F.sum(amount).over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0))
    limit = F.max(amount).over(W.partitionBy("o_custkey")) * 4
    rows = t.orders.select("o_orderkey", so_far.alias("s"), limit.alias("l"))
    return rows.select("o_orderkey", F.col("s").cast("double").alias("billed_to_date"), (F.col("l") - F.col("s")).cast("double").alias("balance"), outcome(F.col("s") <= F.col("l")).alias("outcome"))


@query(
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 2 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 1),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 2 THEN NULL WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 8 <> 1)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.v = b.v THEN a.v END AS total,
  CASE WHEN a.v IS NULL AND b.v IS NULL THEN 'NOT_PRINTED' WHEN a.v IS NULL OR b.v IS NULL THEN 'ONE_READER' WHEN a.v = b.v THEN 'AGREED' ELSE 'UNREADABLE' END AS status
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey"""
)
def two_readers(t: Tables) -> DataFrame:
    """Two readings of the same totals: the value stands only where both agree."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    a = t.orders.where(k % 7 != 1).select(k, F.when(k % 9 != 2, v).alias("total"))
    b = t.orders.where(k % 8 != 1).select(k, F.when(k % 12 != 2, F.when(k % 31 == 0, v + 1).otherwise(v)).alias("total"))
    return reconcile.agree(a, b, ["o_orderkey"], "total")


@query(
    """WITH r AS (SELECT o_orderkey, 'INV-' || CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '' END || (o_orderkey % 5000) || CASE WHEN o_orderkey % 29 = 0 THEN '-R2' ELSE '' END AS number, o_custkey % 200 AS vendor FROM orders),
k AS (SELECT *, regexp_replace(replace(number, '-', '|'), '(^|\\|)0+([0-9])', '\\1\\2', 'g') AS tight0 FROM r),
t AS (SELECT *, CASE WHEN tight0 LIKE '%|R2' THEN replace(tight0, '|R2', '|R|2') ELSE tight0 END AS tight FROM k),
v AS (SELECT *, regexp_replace(tight, '\\|R\\|2$', '') AS base FROM t),
f AS (SELECT o_orderkey, number, vendor, tight, base, min(o_orderkey) OVER (PARTITION BY vendor, number) AS f1, min(o_orderkey) OVER (PARTITION BY vendor, tight) AS f2, min(o_orderkey) OVER (PARTITION BY vendor, base) AS f3 FROM v)
SELECT o_orderkey, number, vendor, CASE WHEN f1 <> o_orderkey THEN 1 WHEN f2 <> o_orderkey THEN 2 WHEN f3 <> o_orderkey THEN 3 END AS tier,
  CASE WHEN f1 <> o_orderkey THEN 'exact' WHEN f2 <> o_orderkey THEN 'formatting' WHEN f3 <> o_orderkey THEN 'revision' END AS kind,
  CASE WHEN f1 <> o_orderkey THEN f1 WHEN f2 <> o_orderkey THEN f2 WHEN f3 <> o_orderkey THEN f3 END AS earlier FROM f"""
)
def duplicate_tiers(t: Tables) -> DataFrame:
    """Bills numbered as written by vendors: the strongest tier at which an earlier bill is the same."""
    k = F.col("o_orderkey")
    number = F.concat(F.lit("INV-"), F.when(k % 3 == 0, "00").otherwise(""), (k % 5000).cast("string"), F.when(k % 29 == 0, "-R2").otherwise(""))
    rows = t.orders.select("o_orderkey", number.alias("number"), (F.col("o_custkey") % 200).alias("vendor"))
    rows = duplicates.written_alike(rows, "number")
    tiers = {"exact": ["vendor", "number"], "formatting": ["vendor", "tight"], "revision": ["vendor", "base"]}
    found = duplicates.nearest_earlier(rows, "o_orderkey", "o_orderkey", tiers)
    return found.select("o_orderkey", "number", "vendor", "tier", "kind", "earlier")


_VENDOR = "regexp_replace(trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[.,''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '( (inc|incorporated|llc|ltd|limited|co|company|corp|corporation|gmbh|sa|plc|llp|lp))+$', '')"


@query(
    f"""WITH r AS (SELECT o_orderkey AS id, o_orderdate < TIMESTAMP '1996-01-01' AS old, o_custkey AS c, CASE WHEN o_orderkey % 50 = 7 THEN ' ' ELSE 'INV-' || CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '' END || (o_orderkey % 4000) END AS number,
  CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) || ', Inc.' WHEN 2 THEN replace(c_name, 'Cu', 'uC') END AS vendor, CASE WHEN o_custkey % 5 = 0 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'us-' ELSE 'US ' END) || o_custkey WHEN o_custkey % 5 = 1 THEN ' ' END AS tax,
  CASE WHEN o_custkey % 7 = 0 THEN 'V' || (o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) WHEN o_custkey % 7 = 1 THEN '' END AS vid, CASE WHEN o_orderkey % 8 > 0 THEN 'PO' || o_custkey ELSE ' ' END AS po, floor(o_totalprice / 50000)::DOUBLE AS total FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT * REPLACE (nullif(trim(vid), '') AS vid, nullif(trim(po), '') AS po), nullif(trim(upper(number)), '') AS ex, nullif(trim(replace(regexp_replace(upper(number), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '-', '')), '') AS lo, {_VENDOR.format("vendor")} AS nm, nullif(replace(upper(replace(tax, '-', '')), ' ', ''), '') AS tx FROM r),
b AS (SELECT * FROM n WHERE NOT old), h AS (SELECT * FROM n WHERE old),
p AS (SELECT b.id, h.id AS booked, coalesce(b.ex = h.ex, false) AS exact, coalesce(b.lo = h.lo, false) AS loose, coalesce(b.po = h.po, false) AS po, b.total = h.total AS total, b.tx AS t1, h.tx AS t2, b.vid AS v1, h.vid AS v2,
  CASE WHEN b.vendor IS NULL OR h.vendor IS NULL THEN 'unknown' WHEN lower(b.vendor) = lower(h.vendor) THEN 'same' WHEN b.nm = h.nm THEN 'variant'
    WHEN damerau_levenshtein(b.nm, h.nm) <= CASE WHEN greatest(length(b.nm), length(h.nm)) < 16 THEN 1 ELSE 2 END THEN 'near' ELSE 'different' END AS names
  FROM b JOIN h ON b.ex = h.ex OR b.lo = h.lo OR (b.po = h.po AND b.total = h.total)),
m AS (SELECT *, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN CASE WHEN t1 = t2 THEN 'same' WHEN names IN ('same', 'variant', 'near') THEN 'conflict' ELSE 'different' END
  WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN CASE WHEN v1 = v2 THEN 'same' WHEN names IN ('same', 'variant') THEN 'variant' WHEN names = 'near' THEN 'near' ELSE 'different' END ELSE names END AS match FROM p),
t AS (SELECT *, CASE WHEN exact AND match IN ('same', 'unknown') THEN 1 WHEN exact AND match = 'variant' THEN 2 WHEN exact AND match = 'near' THEN 3 WHEN exact AND (match = 'conflict' OR (match = 'different' AND (po OR total))) THEN 4
  WHEN loose AND NOT exact AND match NOT IN ('different', 'conflict') THEN 5 WHEN po AND total AND match NOT IN ('different', 'conflict') THEN 6 END AS tier FROM m),
k AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, booked) = 1)
SELECT b.id, CASE WHEN tier IS NULL THEN 'PASS' WHEN tier <= 3 THEN 'FAIL' ELSE 'INSUFFICIENT_DATA' END AS outcome, tier::INT AS tier, booked, match FROM b LEFT JOIN k USING (id)"""
)
def duplicate_ladder(t: Tables) -> DataFrame:
    """Later bills against those booked before 1996: vendors by tax number, vendor id, then name, and six tiers of likeness.
    Some numbers, tax numbers, vendor ids and orders are blank."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.concat(F.upper("c_name"), F.lit(", Inc."))).when(k % 4 == 2, F.regexp_replace("c_name", "Cu", "uC"))
    rows = t.orders.join(t.customer.select("c_custkey", "c_name"), F.col("c_custkey") == c).select(
        k.alias("id"), (F.col("o_orderdate").cast("date") < F.to_date(F.lit("1996-01-01"))).alias("old"),
        F.when(k % 50 == 7, " ").otherwise(F.concat(F.lit("INV-"), F.when(k % 3 == 0, "00").otherwise(""), (k % 4000).cast("string"))).alias("number"), name.alias("vendor"),
        F.when(c % 5 == 0, F.concat(F.when(k % 2 == 0, "us-").otherwise("US "), c.cast("string"))).when(c % 5 == 1, " ").alias("tax"),
        F.when(c % 7 == 0, F.concat(F.lit("V"), (c + F.when(k % 6 == 0, 1).otherwise(0)).cast("string"))).when(c % 7 == 1, "").alias("vendor_id"),
        F.when(k % 8 > 0, F.concat(F.lit("PO"), c.cast("string"))).otherwise(" ").alias("po"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("total"),
    )
    return duplicates.duplicate_claims(rows.where("not old"), rows.where("old")).drop("kind")


@query(
    """WITH d AS (SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents)
SELECT doc_id, first_id, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) AS n FROM d) WHERE n > 1"""
)
def repeated_texts(t: Tables) -> DataFrame:
    """Documents whose text, blanks and case apart, stands in others, with the first of them."""
    h = F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    keyed = t.documents.select("doc_id", h.alias("h"))
    groups = keyed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "h").select("doc_id", "first_id", "n")


@query(
    """WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark),
k AS (SELECT item_id, q, array_to_string(string_split(q, ' ')[1:5], ' ') AS a FROM b)
SELECT doc_id, item_id, strpos(t, q)::BIGINT AS place FROM n, k WHERE contains(t, q)"""
)
def quote_verbatim(t: Tables) -> DataFrame:
    """Which documents hold which quotations, word for word, and where in the form that compares."""
    return quotes.verbatim(t.documents, t.benchmark, "doc_id", "item_id").select("doc_id", "item_id", "place")
