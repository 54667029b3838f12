"""Rulesets: lists of checks over the columns that a binding query makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import whole
from ..operators.claims import Check

#: Header against lines: the stated total, what the lines come to, and that no line is free.
FOOTING = [
    Check("TOTAL_FOOTS", "=", "total", "recomputed", relative=(0.0003, 1e12)),
    Check("TOTAL_COVERS_NET", ">=", "total", "net"),
    Check("LINES_NUMBERED", "=", "n_lines", "n_numbers", tol=0, applies="n_lines > 1"),
]

INVOICE = [
    Check("SUM_INT", "=", "subtotal", "lines_sum"),
    Check("TOTAL_INT", "=", "total", "subtotal + tax - abs(discount)"),
    Check("TAX_INT", "=", "tax", "subtotal * tax_rate", tol=1.0),
]

#: Line of a payment application: C scheduled, D previous, E this period, F stored, G completed, H balance.
PAY_LINES = [
    Check("G703_TOTAL", "=", "completed", "previous + this_period + stored"),
    Check("G703_BAL", "=", "balance", "scheduled - completed"),
    Check("G703_PCT", "=", "percent", "try_divide(completed, scheduled)", tol=0.005),
    Check("G703_CAP", "<=", "completed", "scheduled"),
    Check("G703_PREV", "=", "previous", "previous_completed", applies="has_previous"),
]
PAY_HEADER = [
    Check("G702_CSUM", "=", "contract_to_date", "original + changes"),
    Check("G702_SOV", "=", "contract_to_date", "sum_scheduled"),
    Check("G702_DONE", "=", "completed_stored", "sum_completed"),
    Check("G702_RATE", "=", "retainage", "completed_stored * retainage_rate"),
    Check("G702_EARN", "=", "earned", "completed_stored - retainage"),
    Check("G702_DUE", "=", "due", "earned - earlier_certificates"),
    Check("G702_BAL", "=", "balance", "contract_to_date - earned"),
    Check("G702_PREV", "=", "earlier_certificates", "previous_earned", applies="has_previous"),
]

E_INVOICE = [
    Check("LINES_SUM_INT", "=", "net", "lines_net"),
    Check("TAX_EXCL_INT", "=", "tax_exclusive", "net - coalesce(allowance, 0) + coalesce(charge, 0)"),
    Check("TAX_INCL_INT", "=", "tax_inclusive", "tax_exclusive + vat"),
    Check("PAYABLE_INT", "=", "payable", "tax_inclusive - coalesce(prepaid, 0) + coalesce(rounding, 0)"),
    Check("R120_SUM", "<=", "line_deviation", "0.02", tol=0),
    Check("BUYER_REFERENCE", "EXISTS", "buyer", unless_all=("buyer",)),
    Check("BRCO14_VAT_SUM", "=", "vat", "vat_sum", fail_if_null=("vat_sum",)),
    Check("R051_CURRENCY", "=", "n_currencies", "1", tol=0, unless_all=("n_currencies",)),
]


def order_binding(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders as bills: one row per order, its stated total, and what all its lines come to (null without lines)."""
    price, d, t = (F.col(c).cast("decimal(18,4)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    lines = lineitem.select("l_orderkey", "l_linenumber", price.alias("p"), (price * (1 - d)).alias("n"), (price * (1 - d) * (1 + t)).alias("g"))
    sums = lines.groupBy("l_orderkey").agg(
        whole(F.sum("p"), "p").cast("double").alias("net"), whole(F.sum("n"), "n").cast("double").alias("discounted"),
        whole(F.sum("g"), "g").cast("double").alias("recomputed"), F.count("*").alias("n_lines"),
        F.countDistinct("l_linenumber").alias("n_numbers"),
    )
    total = F.col("o_totalprice").cast("double").alias("total")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", total).join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def pay_applications(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payment applications: each customer's orders in order of time are applications, the lines' return flags items.

    The lines are as read from such forms, with mistakes in them: an item's balance is off by a cent on every seventh
    application, and its share of completion is rounded to two places.
    """
    from pyspark.sql import Window as W

    by_customer = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    apps = orders.withColumn("app", F.row_number().over(by_customer)).select("o_orderkey", "o_custkey", "app")
    quantity, price = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)")
    items = lineitem.join(apps, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "app", F.col("l_returnflag").alias("item"))
    items = items.agg(F.sum(price).alias("this"), F.sum(quantity).alias("stored"))
    before = W.partitionBy("o_custkey", "item").orderBy("app")
    completed = F.sum(F.col("this") + F.col("stored")).over(before.rowsBetween(W.unboundedPreceding, 0))
    items = items.withColumn("g", completed).withColumn("d", F.lag("g").over(before))
    items = items.withColumn("c", F.sum(F.col("this") + 1000).over(W.partitionBy("o_custkey", "item")))
    d = lambda x: F.col(x).cast("double")
    lines = items.select(
        "o_custkey", "app", "item", d("c").alias("scheduled"), F.coalesce(d("d"), F.lit(0.0)).alias("previous"), d("this").alias("this_period"),
        d("stored").alias("stored"), d("g").alias("completed"), F.col("d").isNotNull().alias("has_previous"), d("d").alias("previous_completed"),
        (F.col("c") - F.col("g") + F.when(F.col("app") % 7 == 0, 0.05).otherwise(0).cast("decimal(4,2)")).cast("double").alias("balance"),
        F.floor(d("g") / d("c") * 100 + 0.5).cast("double").alias("_pct"),
    ).withColumn("percent", F.col("_pct") / 100).drop("_pct")
    sums = items.groupBy("o_custkey", "app").agg(F.sum("c").alias("sc"), F.sum("g").alias("sg"))
    by_app = W.partitionBy("o_custkey").orderBy("app")
    kept = (F.col("sg") * F.lit("0.10").cast("decimal(4,2)")).alias("kept")
    sums = sums.select("*", kept).withColumn("earned", F.col("sg") - F.col("kept")).withColumn("pe", F.lag("earned").over(by_app))
    # the header as read from such forms, with mistakes of its own
    off = lambda n, by: F.when(F.col("app") % n == 0, by).otherwise(0.0)
    head = sums.select(
        "o_custkey", "app", (d("sc") - 500.0 + off(7, 10.0)).alias("original"), (F.lit(500.0) + off(6, 25.0)).alias("changes"), (d("sc") + off(7, 10.0)).alias("contract_to_date"),
        d("sc").alias("sum_scheduled"), (d("sg") + off(8, 1.0)).alias("completed_stored"), d("sg").alias("sum_completed"), d("kept").alias("retainage"),
        F.lit(0.1).alias("retainage_rate"), d("earned").alias("earned"), F.coalesce(d("pe") + off(9, 2.0), F.lit(0.0)).alias("earlier_certificates"),
        F.col("pe").isNotNull().alias("has_previous"), d("pe").alias("previous_earned"),
        ((F.col("earned") - F.coalesce(F.col("pe"), F.lit(0))).cast("double") + off(5, 0.05)).alias("due"), (F.col("sc") - F.col("earned")).cast("double").alias("balance"),
    )
    return lines, head
