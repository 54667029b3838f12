"""Queries on orders and receipts written as text, values that texts state, and fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.outcome import outcome
from ..operators import ledger, markup
from .registry import Tables, query


def order_letters(t: Tables) -> DataFrame:
    """One letter an order and one for its receipt: lines numbered by part, amounts grouped, and terms as its priority has them."""
    # by order from the start: what follows, up to the reading of letters, is exchanged no more
    lines = t.lineitem.repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(
        F.sum(F.col("l_quantity").cast("int")).alias("qty"), F.max(F.col("l_extendedprice").cast("decimal(12,2)")).alias("unit"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int")).otherwise(0)).alias("received"),
    )
    said = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    part = said(F.col("l_partkey"))
    ordered = F.concat(F.lit("  "), part, F.lit(". Part #"), part, F.lit(" | qty "), said(F.format_number("qty", 0)), F.lit(" | unit USD "), said(F.format_number("unit", 2)))
    got = F.concat(part, F.lit(". Part #"), part, F.lit(" | received "), said(F.format_number("received", 0)))
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(ordered)), "\n").alias("ordered"), F.array_join(F.sort_array(F.collect_list(got)), "\n").alias("got"))
    urgency = F.substring("o_orderpriority", 1, 1)
    freight = F.when(urgency == "1", "Freight: may be added").when(urgency == "2", "Freight: not allowed").when(urgency == "3", "Freight: vendor pays").otherwise("Freight: as agreed")
    tax = F.when(urgency == "1", "Tax: 8.25%").when(urgency == "2", "Sales tax rate: exempt").when(urgency == "3", "Tax: 0%").when(urgency == "4", "Tax: 140%").otherwise("")
    rows = t.orders.select("o_orderkey", freight.alias("freight"), tax.alias("tax")).join(texts, F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.concat(F.lit("Purchase order PO-"), F.col("o_orderkey").cast("string"), F.lit(" | Vendor: Acme | "), "freight", F.lit("\n"), "tax", F.lit("\n"))
    return rows.select("o_orderkey", F.concat(head, "ordered", F.lit("\nThank you.")).alias("letter"), F.concat(F.lit("Goods receipt\n"), "got").alias("receipt"))


@query(
    """WITH l AS (SELECT l_orderkey AS o_orderkey, l_partkey, sum(l_quantity::INT) AS qty, max(l_extendedprice::DECIMAL(12,2)) AS unit, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::INT ELSE 0 END) AS received FROM lineitem GROUP BY ALL)
SELECT o_orderkey, count(*) AS n_lines, sum(qty * unit)::DOUBLE AS total, count(*) FILTER (WHERE received < qty) AS n_short, CASE WHEN count(*) FILTER (WHERE received < qty) = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM l GROUP BY 1"""
)
def letters_matched(t: Tables) -> DataFrame:
    """Orders and receipts read from their letters and matched line by line: whether all that was ordered came."""
    rows = markup.lines_received(order_letters(t), "o_orderkey", "letter", "receipt").withColumn("short", F.coalesce(F.col("received"), F.lit(0)) < F.col("qty"))
    sums = rows.groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.sum(F.col("qty") * F.col("unit")).cast("double").alias("total"), F.count_if("short").alias("n_short"))
    return sums.withColumn("outcome", outcome(F.col("n_short") == 0))


@query(
    """SELECT o_orderkey, 'PO-' || o_orderkey AS number, CASE o_orderpriority[1] WHEN '1' THEN true WHEN '2' THEN false WHEN '3' THEN false END AS freight, CASE o_orderpriority[1] WHEN '1' THEN 0.0825::DOUBLE WHEN '2' THEN 0 WHEN '3' THEN 0 END AS tax
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
)
def letter_terms(t: Tables) -> DataFrame:
    """Number, freight and tax as order letters state them."""
    return order_letters(t).select("o_orderkey", *[c.alias(n) for n, c in markup.order_terms(F.col("letter")).items()])


_FORM = "regexp_matches(text, '(^|[^0-9.,]|[^0-9][.,]|^[.,])' || replace({0}, '.', '\\.') || '($|[^0-9.,]|[.,]($|[^0-9]))')"


@query(
    f"""WITH n AS (SELECT doc_id, text, regexp_extract(text, '[0-9]+') AS f FROM documents), c AS (SELECT doc_id, text, 'stated' AS claim, try_cast(f AS DECIMAL(18,0)) AS v FROM n UNION ALL SELECT doc_id, text, 'cut', try_cast(left(f, len(f) - 1) AS DECIMAL(18,0)) FROM n),
g AS (SELECT *, v::VARCHAR AS a, format('{{:,}}', v::BIGINT) AS b FROM c WHERE v IS NOT NULL)
SELECT doc_id, claim, v::BIGINT AS value, CASE WHEN {_FORM.format("a")} THEN a WHEN {_FORM.format("a || '.00'")} THEN a || '.00' WHEN {_FORM.format("b")} THEN b WHEN {_FORM.format("b || '.00'")} THEN b || '.00' END AS form FROM g"""
)
def value_claims(t: Tables) -> DataFrame:
    """Whether a document states a value as a number of its own: the first digits in it, and these less the last one."""
    first = F.regexp_extract("text", "[0-9]+", 0)
    claims = F.array(F.struct(F.lit("stated").alias("claim"), first.alias("raw")), F.struct(F.lit("cut").alias("claim"), F.substring(first, F.lit(1), F.length(first) - 1).alias("raw")))
    rows = t.documents.select("doc_id", "text", F.explode(claims).alias("c")).select("doc_id", "text", "c.claim", F.col("c.raw").try_cast("decimal(18,0)").alias("v")).where("v is not null")
    return rows.select("doc_id", "claim", F.col("v").cast("long").alias("value"), numbers.written_as("text", F.col("v")).alias("form"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_totalprice::DECIMAL(18,2)) AS h FROM orders),
a AS (SELECT k >> 12 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h, count(*) AS n FROM r GROUP BY 1), b AS (SELECT k >> 12 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h, sum(n) AS n FROM a GROUP BY 1), c AS (SELECT k >> 12 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h, sum(n) AS n FROM b GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY k)) AS hash FROM c"""
)
def orders_fingerprint(t: Tables) -> DataFrame:
    """One hash of all orders in the order of their keys."""
    row = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"))
    return ledger.fingerprint(t.orders, "o_orderkey", row)
