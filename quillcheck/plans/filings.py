"""Queries on filings, which are written from orders first: one a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trees import tree_places
from ..sources import erp, filings
from .registry import Tables, query


@query(
    """WITH o AS (SELECT o_custkey, o_orderdate::DATE AS d, floor(o_totalprice)::BIGINT AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_custkey, 'us-gaap:O' || k AS concept, CASE WHEN k % 7 > 0 AND k % 11 > 0 THEN (CASE WHEN k % 3 = 0 THEN v * 1000 WHEN k % 3 = 1 THEN -v ELSE v END)::DOUBLE END AS value,
CASE WHEN k % 7 > 0 AND k % 2 = 0 THEN d::VARCHAR END AS "instant", CASE WHEN k % 7 > 0 AND k % 2 = 1 THEN d::VARCHAR END AS "start", CASE WHEN k % 7 > 0 AND k % 2 = 1 THEN (d + 30)::DATE::VARCHAR END AS "end",
CASE WHEN k % 5 = 0 THEN 'iso4217:USD / xbrli:shares' ELSE 'iso4217:USD' END AS measured, CASE WHEN k % 13 > 0 THEN 'http://r/' || (o_custkey % 3) ELSE '' END AS roles, o_custkey % 3 = 1 AND k % 13 > 0 AS stated,
CASE WHEN k % 13 > 0 THEN (SELECT count(*) FROM range(1, 40) r(i) WHERE k >> i > 0 AND NOT list_bool_or([(k >> j) % 13 = 0 FOR j IN range(1, i + 1)])) END AS depth, CASE WHEN k % 7 = 0 THEN 'no context' WHEN k % 11 = 0 THEN 'no number' END AS problem FROM o"""
)
def filing_facts(t: Tables) -> DataFrame:
    """A filing for each customer, with an order a fact, read back: each fact's value, period and unit, the roles that present its
    concept, and how deep. Some contexts are missing, some facts are words, and some concepts are not presented."""
    order = F.struct("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.floor("o_totalprice").alias("v"))
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(order)).alias("os"))
    each = lambda text: f"array_join(transform(os, (o, i) -> {text}), ' ')"
    period = "if(i % 2 = 1, concat('<instant>', o.d, '</instant>'), concat('<startDate>', o.d, '</startDate><endDate>', date_add(o.d, 30), '</endDate>'))"
    contexts = each(f"if(i % 7 = 6, '', concat('<xbrli:context id=\"c', i, '\"><period>', {period}, '</period></xbrli:context>'))")
    facts = each(
        "concat('<p>on ', o.d, ' <ix:nonFraction name=\"us-gaap:O', i + 1, '\" contextRef=\"c', i, '\" unitRef=\"', if(i % 5 = 4, 'eps', 'usd'), '\"', "
        "case i % 3 when 2 then ' scale=\"3\"' when 0 then ' sign=\"-\"' else '' end, '>', if(i % 11 = 10, 'many', format_number(o.v, 0)), '</ix:nonFraction></p>')"
    )
    measures = '<xbrli:unit id="usd"><measure>iso4217:USD</measure></xbrli:unit><unit id="eps"><unitNumerator><measure>iso4217:USD</measure></unitNumerator><unitDenominator><measure>xbrli:shares</measure></unitDenominator></unit>'
    role = F.concat(F.lit("http://r/"), (F.col("o_custkey") % 3).cast("string"))
    locs = each("if(i % 13 = 12, '', concat('<link:loc xlink:href=\"a.xsd#us-gaap_O', i + 1, '\" xlink:label=\"l', i + 1, '\"/>'))")
    arcs = each("if(i = 0, '', concat('<link:presentationArc xlink:from=\"l', (i + 1) div 2, '\" xlink:to=\"l', i + 1, '\"/>'))")
    named = F.when(F.col("o_custkey") % 3 == 1, "1 - Statement - Orders").when(F.col("o_custkey") % 3 == 2, "1 - Statement - Orders (Parenthetical)").otherwise("1 - Disclosure - Orders")
    pre = F.concat(
        F.lit('<link:roleType roleURI="'), role, F.lit('"><link:definition>'), named, F.lit('</link:definition></link:roleType><link:presentationLink xlink:role="'), role, F.lit('">'),
        F.expr(locs), F.expr(arcs), F.lit("</link:presentationLink>"),
    )
    files = rows.select("o_custkey", F.concat(F.lit("<html>"), F.expr(contexts), F.lit(measures), F.expr(facts), F.lit("</html>")).alias("html"), pre.alias("pre"))
    keep = ["o_custkey"]
    found = filings.stated_facts(filings.facts(files, keep, "html"), filings.presented(files, keep, "pre"), keep)
    measured = F.concat_ws(" / ", F.array_join("measures", " "), F.nullif(F.array_join("per", " "), F.lit("")))
    return found.select("o_custkey", "concept", "value", *[F.col(c).cast("string").alias(c) for c in ("instant", "start", "end")], measured.alias("measured"), F.array_join("roles", " ").alias("roles"), (F.size("statements") > 0).alias("stated"), "depth", "problem")


@query(
    """WITH RECURSIVE n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 > 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS up FROM orders),
w AS (SELECT o_orderkey, o_orderkey AS root, 0 AS depth FROM n WHERE up IS NULL UNION ALL SELECT n.o_orderkey, root, depth + 1 FROM n JOIN w ON n.up = w.o_orderkey)
SELECT n.o_custkey, o_orderkey, root, depth FROM w JOIN n USING (o_orderkey)"""
)
def order_trees(t: Tables) -> DataFrame:
    """Each order under the one before of its customer, some orders beginning anew: where it stands, and under which first one."""
    before = F.expr("lag(o_orderkey) over (partition by o_custkey order by o_orderkey)")
    nodes = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 97 > 0, before).alias("up"))
    return tree_places(nodes, ["o_custkey"], "o_orderkey", "up")


@query(
    """WITH o AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS file, o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d, o_totalprice AS t FROM orders), l AS (SELECT o.*, l_linenumber AS n, l_extendedprice AS a, l_quantity AS q FROM o JOIN lineitem ON l_orderkey = k),
u AS (SELECT file, ['generic', 'netsuite', 'xero'][file % 3 + 1] AS layout, CASE WHEN file % 3 = 1 THEN 'R' || k WHEN k % 10 > 0 THEN k || '|' || d || '|V' || c END AS ref, t, n, CASE WHEN q <> 7 THEN floor(a)::DOUBLE END AS a FROM l WHERE file % 5 > 0)
SELECT file, layout, ref, floor(min(t))::DOUBLE AS total, count(*) AS n_lines, sum(a) AS lines_sum, count(*) - count(a) AS n_problems FROM u WHERE ref IS NOT NULL GROUP BY file, layout, ref"""
)
def export_bills(t: Tables) -> DataFrame:
    """Bills read back from a file for each month of orders, in one of three layouts; some lines' amounts are words, some have no
    number, and the files of some months have no layout."""
    day = F.col("o_orderdate").cast("date")
    orders = t.orders.select(F.year(day).cast("int").alias("y"), F.month(day).alias("m"), day.cast("string").alias("d"), "o_orderkey", "o_custkey", F.floor("o_totalprice").cast("string").alias("total"))
    rows = orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("file", (F.col("y") * 100 + F.col("m")).cast("bigint"))
    k = F.col("o_orderkey").cast("string")
    s = lambda c: F.col(c).cast("string")
    meant = {
        "ref": F.concat(F.lit("R"), k), "invoice_number": F.when(F.col("o_orderkey") % 10 > 0, k).otherwise(""), "vendor": F.concat(F.lit("V"), s("o_custkey")), "date": F.col("d"), "total": F.col("total"), "po": k,
        "item": s("l_partkey"), "quantity": s("l_quantity"), "rate": F.lit("1"), "amount": F.when(F.col("l_quantity") == 7, "seven").otherwise(F.floor("l_extendedprice").cast("string")),
    }

    def cells(layout: str, with_ref: bool):
        return F.create_map(*[x for m, v in meant.items() if with_ref or m != "ref" for x in (F.lit(erp.LAYOUTS[layout][m]), v)])

    kind = F.col("file") % 3
    made = F.when(F.col("file") % 5 == 0, F.create_map(F.lit("A"), k)).when(kind == 0, cells("generic", False)).when(kind == 1, cells("netsuite", True)).otherwise(cells("xero", False))
    frame = rows.select("file", (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("row"), made.alias("cells"))
    found = erp.bills(erp.bill_lines(frame, "file", "row", "cells"), "file", "row")
    return found.select("file", "layout", "ref", "total", "n_lines", "lines_sum", "n_problems")
