"""Bills on purchase orders: which line bills which, what was received and billed before, and what an order has left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.outcome import FAIL, OPEN, PASS
from ..functions.text import plain_width

MATCHED = "matched"


def _sku(x: str) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def match_lines(bill: DataFrame, order: DataFrame) -> DataFrame:
    """Bill lines (doc, line, line_id, sku, ...) with ``po_line``, the line of their order (doc, line_id, sku) that they
    bill, and ``match``: why there is none.

    A line that names an order line is matched by that alone; else its SKU must name exactly one line of the order. Order
    lines that several bill lines claim are matched with none of them. Order lines have ids of their own within a doc.
    """
    return _on_order(bill, order).select(*bill.columns, "po_line", "match")


def _on_order(bill: DataFrame, order: DataFrame, terms: dict[str, str] | None = None, receipts: DataFrame | None = None) -> DataFrame:
    """What ``match_lines`` returns, with ``terms`` (new name by the order's) of the matched order line and what was received on it.

    All papers stand in one frame, which is put together by doc once, and not at all if its parts are by doc already: a bill
    line sees the order lines of its SKU, then those that claim what it claims, as the rows of two windows.
    """
    kind = lambda n: F.lit(n).alias("_kind")
    parts = [bill.select("*", kind("bill"), F.col("line_id").alias("_want"), F.when(F.col("line_id").isNull(), _sku("sku")).alias("_s"))]
    parts.append(order.select("doc", kind("order"), F.col("line_id").alias("_want"), _sku("sku").alias("_s"), *[F.col(c).alias(f"_{n}") for c, n in (terms or {}).items()]))
    if receipts is not None:
        parts.append(receipts.select("doc", kind("receipt"), F.col("line_id").alias("_want"), F.col("quantity").alias("_received")))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    ordered, known = F.col("_kind") == "order", F.col("doc").isNotNull()
    by_sku, by_claim = W.partitionBy("doc", "_s"), W.partitionBy("doc", "_claim")
    rows = rows.withColumns({"_n_sku": F.when(known & F.col("_s").isNotNull(), F.count_if(ordered).over(by_sku)), "_by_sku": F.min(F.when(ordered, F.col("_want"))).over(by_sku)})
    claim = F.when((F.col("_kind") != "bill") | F.col("_want").isNotNull(), F.col("_want")).when(F.col("_n_sku") == 1, F.col("_by_sku"))
    rows = rows.withColumn("_claim", F.when(known, claim))
    there = F.col("_claim").isNotNull() & (F.count_if(ordered).over(by_claim) > 0)
    seen = {f"_on_{n}": F.max(f"_{n}").over(by_claim) for n in (terms or {}).values()}  # one order line a claim
    if receipts is not None:
        seen["_on_received"] = F.sum("_received").over(by_claim)
    rows = rows.withColumns({"_n": F.when(there, F.count_if(F.col("_kind") == "bill").over(by_claim)), **seen}).where("_kind = 'bill'")
    n, want, n_sku = F.col("_n"), F.col("_want"), F.col("_n_sku")
    why = (
        F.when(n == 1, MATCHED).when(n > 1, "several bill lines").when(want.isNotNull(), "no such order line")
        .when(F.col("_s").isNull(), "no order line or SKU named").when(n_sku > 1, "SKU on several order lines").otherwise("SKU on no order line")
    )
    return rows.select(*bill.columns, F.when(n == 1, F.col("_claim")).alias("po_line"), why.alias("match"), *[F.when(n == 1, F.col(c)).alias(c.removeprefix("_on_")) for c in seen])


def line_claims(matched: DataFrame, order: DataFrame, receipts: DataFrame, price_share: float = 0.02, price_floor: float = 0.01) -> DataFrame:
    """Matched lines against the order's price, what was received in all, and what was billed on the line before.

    ``matched`` has quantity and unit_price, ``order`` unit_price and invoiced (to date), ``receipts`` doc, line_id and
    quantity. Claims stay open where there is nothing to compare with. ``billed_to_date`` is null where earlier bills are
    not known or the bill alone is over what was received, and is never failed: a person settles it.
    """
    terms = order.select("doc", F.col("line_id").alias("po_line"), F.col("unit_price").alias("po_price"), "invoiced")
    got = receipts.groupBy("doc", F.col("line_id").alias("po_line")).agg(F.sum("quantity").alias("received"))
    return _claimed(matched.join(terms, ["doc", "po_line"], "left").join(got, ["doc", "po_line"], "left"), price_share, price_floor)


def matched_claims(bill: DataFrame, order: DataFrame, receipts: DataFrame, price_share: float = 0.02, price_floor: float = 0.01) -> DataFrame:
    """``line_claims`` of ``match_lines``: a bill line meets its order line once, with its terms and receipts, for both.

    Frames that are partitioned by doc alone are not exchanged any more.
    """
    return _claimed(_on_order(bill, order, {"unit_price": "po_price", "invoiced": "invoiced"}, receipts), price_share, price_floor)


def _claimed(rows: DataFrame, price_share: float, price_floor: float) -> DataFrame:
    told = lambda ok: F.when(ok, PASS).when(~ok, FAIL).otherwise(OPEN)
    within = F.col("quantity") <= F.col("received") + 1e-9
    limit = F.col("po_price") + F.greatest(F.lit(price_floor), F.col("po_price") * price_share)
    to_date = F.when(F.col("invoiced") + F.col("quantity") <= F.col("received") + 1e-9, PASS).otherwise(OPEN)
    return rows.withColumns(
        {"quantity_claim": told(within), "price_claim": told(F.col("unit_price") <= limit), "billed_to_date": F.when(within & F.col("invoiced").isNotNull(), to_date)}
    )


def order_key(x: Column | str) -> Column:
    """An order number without case, blanks and marks; one of marks alone stands as it is, an empty one is null."""
    upper = F.upper(F.trim(plain_width(x)))
    bare = F.regexp_replace(upper, r"[^\p{L}\p{N}]", "")
    return F.when(bare != "", bare).when(upper != "", upper)


def balance(bills: DataFrame, orders: DataFrame, booked: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether what is booked on a bill's order, and the bill, stay within the order's total.

    ``bills``: bill, vendor, order_number, number, amount, currency. ``orders``: vendor, order_number, order_total (null:
    not known), order_currency. ``booked``: vendor, order_number (null: not known), number, amount, currency, placeless
    (booked without an order). Vendors are told apart by the value in their column. The bill's own number is not counted.
    Booked rows that name no order may or may not be on this one: the bill passes only if it fits with them too. Rows
    without an amount, or in another currency, leave it open, and so does an order that stands more than once with
    different totals or currencies (one that repeats alike counts once). It is never failed: a person settles it.

    Booked rows are summed by order and by vendor, less those of the bill's own number; bills are not paired with them.
    """
    number, zero = (lambda x: F.upper(F.trim(x))), F.lit(0)
    orders = orders.groupBy("vendor", order_key("order_number").alias("o")).agg(
        F.max("order_total").alias("order_total"), F.max("order_currency").alias("order_currency"),
        (F.count_distinct(F.struct("order_total", "order_currency")) > 1).alias("several"),
    )
    orders = orders.withColumn("cu", F.when(~F.col("several"), F.coalesce("order_currency", F.lit(""))).otherwise(""))
    bills = bills.select("bill", "vendor", order_key("order_number").alias("o"), number("number").alias("own"), "amount", "currency")
    rows = booked.where("not (coalesce(placeless, false) and order_number is null)")
    rows = rows.select("vendor", order_key("order_number").alias("o"), number("number").alias("own"), F.col("amount").alias("a"), F.col("currency").alias("c"))
    rows = rows.groupBy("vendor", "o", "own", "c").agg(F.sum("a").alias("a"), F.count("a").alias("n"), F.count_if(F.col("a").isNull()).alias("lost"))
    same = F.col("c").isNull() | (F.col("cu") == "") | (F.col("c") == F.col("cu"))

    def summed(frame: DataFrame, keys: list[str], mark: str) -> DataFrame:
        a, n = F.sum(F.when(same, F.col("a"))), F.sum(F.when(same, F.col("n")).otherwise(0))
        lost = F.sum(F.col("lost") + F.when(same, 0).otherwise(F.col("n")))
        return frame.groupBy(*keys).agg(a.alias(f"{mark}_a"), n.alias(f"{mark}_n"), lost.alias(f"{mark}_lost"))

    placed = rows.where("o is not null").join(orders.select("vendor", "o", "cu"), ["vendor", "o"])
    loose = rows.where("o is null").join(orders.select("vendor", "cu").distinct(), "vendor")
    out = bills.join(orders, ["vendor", "o"], "left")
    for frame, keys, mark in ((placed, ["vendor", "o"], "on"), (loose, ["vendor", "cu"], "any")):
        out = out.join(summed(frame, keys, mark), keys, "left").join(summed(frame, [*keys, "own"], f"{mark}_own"), [*keys, "own"], "left")
    less = lambda mark, c: F.coalesce(f"{mark}_{c}", zero) - F.coalesce(f"{mark}_own_{c}", zero)
    out = out.select(
        "bill", "amount", "currency", "order_total", "order_currency", "several", (less("on", "a") + F.col("amount")).alias("to_date"), less("on", "n").alias("n_booked"),
        less("any", "a").alias("loose"), less("any", "n").alias("n_loose"), (less("on", "lost") + less("any", "lost")).alias("n_lost"),
    )
    limit = F.col("order_total") + tolerance
    reason = (
        F.when(F.col("n_booked") + F.col("n_loose") + F.col("n_lost") == 0, "").when(F.col("several"), "order stands with different totals").when(F.col("order_total").isNull(), "order total not known")
        .when(F.col("currency") != F.col("order_currency"), "currencies differ").when(F.col("to_date") > limit, "over the order")
        .when(F.col("n_lost") > 0, "booked rows that cannot be counted").when(F.col("to_date") + F.col("loose") > limit, "rows without an order may be on it")
        .otherwise("")
    )
    told = F.when(reason == "", PASS).otherwise(OPEN).alias("outcome")
    known = F.when(~F.coalesce("several", F.lit(False)), F.col("order_total")).alias("order_total")
    return out.select("bill", "to_date", known, "n_booked", "n_loose", "n_lost", told, F.nullif(reason, F.lit("")).alias("reason"))
