"""Queries on rules, claims and verdicts over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, stats
from ..functions.outcome import FAIL, OPEN, PASS, any_line, compare, outcome, round4, whole
from ..functions.text import same_set
from ..operators.claims import Check, confusion, omissions, run_checks, verdicts, widen
from . import rulesets
from .registry import Tables, query

BOUND = """
b AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice::DOUBLE AS total, net, discounted, recomputed, n_lines, n_numbers
  FROM orders LEFT JOIN (
    SELECT l_orderkey, sum(p)::DOUBLE AS net, sum(n)::DOUBLE AS discounted, sum(g)::DOUBLE AS recomputed,
           count(*) AS n_lines, count(DISTINCT l_linenumber) AS n_numbers
    FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,4) AS p,
                 l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4))::DECIMAL(18,4) AS n,
                 (l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4))::DECIMAL(9,4))::DECIMAL(20,8)
                 * (1 + l_tax::DECIMAL(18,4))::DECIMAL(9,4) AS g
          FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
R4 = "floor(({}) * 1e4 + 0.5) / 1e4"


def _claim_sql(rule: str, left: str, right: str, held: str, applies: str = "true") -> str:
    """SQL of one claim of the table b: held is null where it cannot be told."""
    return f"""
SELECT o_orderkey, '{rule}' AS rule, CASE WHEN {applies} IS NULL OR ({held}) IS NULL THEN 'INSUFFICIENT_DATA' WHEN {held} THEN 'PASS' ELSE 'FAIL' END AS outcome,
       {R4.format(left)} AS asserted, {R4.format(right)} AS expected,
       CASE WHEN {applies} AND NOT ({held}) THEN {R4.format(f"({left}) - ({right})")} END AS variance,
       CASE WHEN {applies} IS NULL THEN 'applicability unknown' WHEN ({held}) IS NULL THEN 'operand missing' END AS reason, false AS advisory
FROM b WHERE ({applies}) IS NULL OR {applies}"""


FOOTING_SQL = "WITH " + BOUND + ",\nc AS (" + " UNION ALL ".join(
    [
        _claim_sql("TOTAL_FOOTS", "total", "recomputed", "CASE WHEN recomputed IS NOT NULL THEN abs(total - recomputed) <= greatest(0.01, least(0.0003 * abs(recomputed), 1e12)) END"),
        _claim_sql("TOTAL_COVERS_NET", "total", "net", "total >= net - 0.01"),
        _claim_sql("LINES_NUMBERED", "n_lines", "n_numbers", "n_lines = n_numbers", "(n_lines > 1)"),
    ]
) + ")"


def footing(t: Tables) -> DataFrame:
    return run_checks(rulesets.order_binding(t.orders, t.lineitem), ["o_orderkey"], rulesets.FOOTING)


@query(FOOTING_SQL + "\nSELECT * FROM c")
def footing_claims(t: Tables) -> DataFrame:
    """Every claim of the footing rules on orders."""
    return footing(t)


_VERDICT_SQL = """
SELECT {keys}, count(*) AS n_total, count(*) FILTER (WHERE outcome = 'PASS') AS n_pass, count(*) FILTER (WHERE outcome = 'FAIL') AS n_fail,
       count(*) FILTER (WHERE outcome = 'INSUFFICIENT_DATA') AS n_open,
       CASE WHEN bool_or(outcome = 'FAIL') THEN 'FAIL' WHEN bool_or(outcome = 'PASS') THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS outcome,
       CASE WHEN bool_or(outcome = 'FAIL') THEN 'FAIL' WHEN bool_or(outcome = 'PASS') AND bool_or(outcome = 'INSUFFICIENT_DATA') THEN 'PASS-WITH-OPEN'
            WHEN bool_or(outcome = 'PASS') THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS gate
FROM c GROUP BY {keys}"""


@query(FOOTING_SQL + _VERDICT_SQL.format(keys="o_orderkey"))
def footing_verdicts(t: Tables) -> DataFrame:
    """The verdict on every order: coverage counts, outcome and gate."""
    return verdicts(footing(t), ["o_orderkey"])


@query(FOOTING_SQL + ", v AS (" + _VERDICT_SQL.format(keys="o_orderkey") + ") SELECT outcome, gate, count(*) AS n FROM v GROUP BY outcome, gate")
def batch_summary(t: Tables) -> DataFrame:
    """Orders by outcome and gate."""
    return verdicts(footing(t), ["o_orderkey"]).groupBy("outcome", "gate").agg(F.count("*").alias("n"))


@query(
    FOOTING_SQL
    + """ SELECT rule, count(*) AS n_failed, sum(abs(variance)::DECIMAL(18,4))::DOUBLE AS total_variance, max_by(variance, o_orderkey) AS last_variance
FROM c WHERE outcome = 'FAIL' GROUP BY rule"""
)
def variance_summary(t: Tables) -> DataFrame:
    """Failed claims by rule: how many, their absolute variances together, and the last one's."""
    failed = footing(t).where(F.col("outcome") == FAIL)
    return failed.groupBy("rule").agg(
        F.count("*").alias("n_failed"), F.sum(F.abs("variance").cast("decimal(18,4)")).cast("double").alias("total_variance"),
        F.max_by("variance", "o_orderkey").alias("last_variance"),
    )


@query(
    FOOTING_SQL
    + """ SELECT o_orderkey, rule, CASE WHEN w THEN 'PASS' ELSE outcome END AS outcome, asserted, expected, variance,
       CASE WHEN w THEN 'within tolerance' ELSE reason END AS reason, advisory
FROM (SELECT *, coalesce(outcome = 'FAIL' AND abs(variance) <= greatest(5.0, least(0.2 * abs(expected), 20000.0)), false) AS w FROM c)"""
)
def tolerance_band(t: Tables) -> DataFrame:
    """Claims after a tolerance policy: a floor of 5, a fifth of what is expected, capped at 20,000."""
    return widen(footing(t), 5.0, 0.2, 20_000.0)


@query(
    "WITH " + BOUND + """ SELECT o_orderkey, CASE WHEN net IS NULL THEN 1 WHEN net::DECIMAL(18,2) % 1 = 0 THEN 1.0 ELSE 0.01 END::DOUBLE AS grain,
  (CASE WHEN (round(total * 100)::BIGINT) % 100 = 0 THEN 1.0 WHEN (round(total * 100)::BIGINT) % 50 = 0 THEN 0.5
        WHEN (round(total * 100)::BIGINT) % 10 = 0 THEN 0.1 WHEN (round(total * 100)::BIGINT) % 5 = 0 THEN 0.05 ELSE 0.01 END)::DOUBLE AS cash_step
FROM b"""
)
def rounding_steps(t: Tables) -> DataFrame:
    """The grain that each order's net amount is written in and the step that its total is rounded to."""
    b = rulesets.order_binding(t.orders, t.lineitem)
    grain = F.when(F.col("net").isNull() | (F.col("net").cast("decimal(18,2)") % 1 == 0), 1.0).otherwise(0.01)
    return b.select("o_orderkey", grain.alias("grain"), numbers.cash_step(F.col("total"), F.lit(0.01)).alias("cash_step"))


@query(
    """SELECT o_custkey, CASE WHEN bool_and(v % 100000 = 0) THEN CASE WHEN bool_and(v % 1000000 = 0) THEN 1000000 ELSE 100000 END
        WHEN bool_and(v % 1000 = 0) THEN 1000 ELSE 1 END AS unit
FROM (SELECT o_custkey, round(o_totalprice / 1000)::BIGINT * CASE WHEN o_custkey % 3 = 0 THEN 1000 ELSE 100000 END AS v FROM orders) GROUP BY o_custkey"""
)
def reporting_units(t: Tables) -> DataFrame:
    """The reporting unit of each customer's figures, which are given in thousands or hundred thousands."""
    v = F.round(F.col("o_totalprice") / 1000).cast("long") * F.when(F.col("o_custkey") % 3 == 0, 1000).otherwise(100_000)
    return t.orders.select("o_custkey", v.alias("v")).groupBy("o_custkey").agg(numbers.reporting_unit(F.col("v")).alias("unit"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN ok IS NULL THEN 'INSUFFICIENT_DATA' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS outcome,
       recomputed::DOUBLE AS recomputed
FROM (SELECT *, abs(l_extendedprice::DECIMAL(18,2) - recomputed) <= 0.01 AS ok
      FROM (SELECT l.*, round((l_quantity::DECIMAL(9,2) * p_retailprice::DECIMAL(12,2))::DECIMAL(28,4), 2) AS recomputed
            FROM lineitem l LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40))"""
)
def line_math(t: Tables) -> DataFrame:
    """Line amounts against quantity times list price, exact to a cent; open for parts that the list leaves out."""
    parts = t.part.where("p_size <= 40").select("p_partkey", "p_retailprice")
    rows = t.lineitem.join(parts, F.col("p_partkey") == F.col("l_partkey"), "left")
    recomputed = F.round(F.col("l_quantity").cast("decimal(9,2)") * F.col("p_retailprice").cast("decimal(12,2)"), 2)
    ok = F.abs(F.col("l_extendedprice").cast("decimal(18,2)") - recomputed) <= F.lit("0.01").cast("decimal(4,2)")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", outcome(ok).alias("outcome"), recomputed.cast("double").alias("recomputed"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL THEN 'INSUFFICIENT_DATA' WHEN a THEN 'PASS' ELSE 'FAIL' END AS rate_outcome,
       CASE WHEN c IS NULL THEN 'INSUFFICIENT_DATA' WHEN c THEN 'PASS' ELSE 'FAIL' END AS cap_outcome
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_quantity, 0) <= nullif(p_retailprice, 0) * 1.05 AS a,
             l_extendedprice <= p_size * 2000.0 AS c
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
)
def rate_and_cap(t: Tables) -> DataFrame:
    """Applied against contracted rates with five percent allowed, and amounts against a limit."""
    rows = t.lineitem.join(t.part.select("p_partkey", "p_retailprice", "p_size"), F.col("p_partkey") == F.col("l_partkey"), "left")
    applied = F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))
    a = compare("<=", applied, F.nullif("p_retailprice", F.lit(0.0)) * 1.05)
    c = compare("<=", "l_extendedprice", F.col("p_size") * 2000.0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", outcome(a).alias("rate_outcome"), outcome(c).alias("cap_outcome"))


@query(
    """SELECT l_orderkey, CASE WHEN bool_or(late) THEN 'FAIL' WHEN count(*) FILTER (WHERE late IS NULL) > 0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS outcome,
       count(*) FILTER (WHERE late) AS n_violations
FROM (SELECT l_orderkey, NOT (l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 2000 DAY) AS late
      FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey) GROUP BY l_orderkey"""
)
def time_order(t: Tables) -> DataFrame:
    """Whether every line of an order ships between its date and 2,000 days on; an order date may be missing."""
    rows = t.lineitem.join(t.orders.where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    late = ~F.col("l_shipdate").between(F.col("o_orderdate"), F.expr("o_orderdate + INTERVAL 2000 DAY"))
    lines = rows.select("l_orderkey", late.alias("late")).groupBy("l_orderkey")
    violated = any_line("late")
    return lines.agg(outcome(~violated).alias("outcome"), F.count_if("late").alias("n_violations"))


@query(
    """SELECT l_orderkey, CASE WHEN count(*) = count(t) THEN floor(sum(t)::DOUBLE * 1e4 + 0.5) / 1e4 END AS tax_sum, count(t) AS n_read, count(*) AS n_lines
FROM (SELECT l_orderkey, nullif(l_tax, 0.08)::DECIMAL(18,4) AS t FROM lineitem) GROUP BY l_orderkey"""
)
def guarded_sum(t: Tables) -> DataFrame:
    """Sums that are there only if every line could be read (a tax of 0.08 stands for unreadable)."""
    lines = t.lineitem.select("l_orderkey", F.nullif("l_tax", F.lit(0.08)).cast("decimal(18,4)").alias("t"))
    total = round4(whole(F.sum("t"), "t"))
    return lines.groupBy("l_orderkey").agg(total.alias("tax_sum"), F.count("t").alias("n_read"), F.count("*").alias("n_lines"))


@query(
    """SELECT l_orderkey, CASE WHEN u = 0 THEN n END AS n_rows, CASE WHEN u = 0 AND n = k THEN mid END AS median_price, CASE WHEN u = 0 AND n = k THEN lo END AS least_price,
       CASE WHEN u = 0 AND n = k THEN hi END AS most_price, CASE WHEN u = 0 AND n = k AND n > 0 THEN s::DOUBLE END AS sum_price
FROM (SELECT l_orderkey, count(*) FILTER (WHERE m IS NULL) AS u, count(*) FILTER (WHERE m) AS n, count(p) FILTER (WHERE m) AS k,
             median(p) FILTER (WHERE m) AS mid, min(p) FILTER (WHERE m) AS lo, max(p) FILTER (WHERE m) AS hi, sum(p::DECIMAL(18,4)) FILTER (WHERE m) AS s
      FROM (SELECT l_orderkey, CASE WHEN l_discount = 0.1 AND l_linestatus = 'F' THEN NULL ELSE l_linestatus = 'O' END AS m,
                   CASE WHEN l_quantity < 49 THEN l_extendedprice END AS p FROM lineitem) GROUP BY l_orderkey)"""
)
def row_sets(t: Tables) -> DataFrame:
    """Aggregates over the rows of a set: unknown if any row's membership is, or if a member lacks its price."""
    member = F.when((F.col("l_discount") == 0.1) & (F.col("l_linestatus") == "F"), None).otherwise(F.col("l_linestatus") == "O")
    price = F.when(F.col("l_quantity") < 49, F.col("l_extendedprice"))
    lines = t.lineitem.select("l_orderkey", member.alias("m"), price.alias("p")).groupBy("l_orderkey")
    in_set = lambda f, x: f(F.when(F.col("m"), x))
    known = F.count_if(F.col("m").isNull()) == 0
    read = known & (F.count_if("m") == in_set(F.count, F.col("p")))
    return lines.agg(
        F.when(known, F.count_if("m")).alias("n_rows"), F.when(read, in_set(F.median, F.col("p"))).alias("median_price"),
        F.when(read, in_set(F.min, F.col("p"))).alias("least_price"), F.when(read, in_set(F.max, F.col("p"))).alias("most_price"),
        F.when(read & (F.count_if("m") > 0), in_set(F.sum, F.col("p").cast("decimal(18,4)"))).cast("double").alias("sum_price"),
    )


@query(
    """SELECT event_id, user_id, value - lag(value) OVER w AS since_previous, lead(value) OVER w - value AS to_next,
       CASE WHEN lag(value) OVER w IS NULL THEN 'NOT_APPLICABLE' WHEN value >= lag(value) OVER w THEN 'PASS' ELSE 'FAIL' END AS not_falling
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def neighbour_rows(t: Tables) -> DataFrame:
    """Each row against the one before and after it; a first row has no neighbour, so the rule does not apply."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    falls = F.when(before.isNull(), "NOT_APPLICABLE").otherwise(outcome(F.col("value") >= before))
    return t.events.select("event_id", "user_id", (F.col("value") - before).alias("since_previous"), (after - F.col("value")).alias("to_next"), falls.alias("not_falling"))


@query(
    """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS presence,
       CASE WHEN c_mktsegment IS NULL THEN 'INSUFFICIENT_DATA' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'PASS' ELSE 'FAIL' END AS membership,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'PASS' ELSE 'FAIL' END AS code_list
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey"""
)
def presence_and_membership(t: Tables) -> DataFrame:
    """Whether a reference is there, and whether its code and the order's are on their lists."""
    rows = t.orders.join(t.customer.where("c_acctbal >= 0"), F.col("c_custkey") == F.col("o_custkey"), "left")
    here = F.when(F.col("c_custkey").isNotNull(), PASS).otherwise(OPEN)
    listed = outcome(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))
    codes = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    return rows.select("o_orderkey", here.alias("presence"), listed.alias("membership"), outcome(compare("IN", "o_orderpriority", codes)).alias("code_list"))


@query(
    """SELECT user_id, n_kinds, CASE WHEN n_kinds = (SELECT count(DISTINCT event_type) FROM events) THEN 'PASS' ELSE 'FAIL' END AS outcome
FROM (SELECT user_id, count(DISTINCT event_type) AS n_kinds FROM events WHERE value < 20 GROUP BY user_id)"""
)
def identifier_sets(t: Tables) -> DataFrame:
    """Whether a user's kinds of small events are the same set as all kinds."""
    all_kinds = t.events.agg(F.array_sort(F.collect_set("event_type")).alias("all"))
    own = t.events.where("value < 20").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("own"))
    both = own.join(F.broadcast(all_kinds))  # one row
    return both.select("user_id", F.size("own").cast("long").alias("n_kinds"), outcome(same_set(F.col("own"), F.col("all"))).alias("outcome"))


LADDER = [
    Check("PAID_IN_FULL", ">=", "total", "net", applies="case when o_orderstatus = 'P' then null else o_orderstatus = 'F' end"),
    Check("NET_PRESENT", "EXISTS", "net", unless_all=("net",)),
    Check("SMALL_ORDER", "<=", "total", "100000", open_if=("n_lines > 6", "net > 400000")),
    Check("ONE_FORM", "<=", "net", forms=((("recomputed",), "recomputed * 1.5"), (("total",), "total"))),
    Check("MUST_READ", "<=", "n_lines", "7", fail_if_null=("n_lines",)),
]
_LADDER_SQL = "WITH " + BOUND + ",\nc AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey, '{rule}' AS rule, {text} AS outcome FROM b {where}"
    for rule, text, where in [
        ("PAID_IN_FULL", "CASE WHEN o_orderstatus = 'P' OR net IS NULL THEN 'INSUFFICIENT_DATA' WHEN total >= net - 0.01 THEN 'PASS' ELSE 'FAIL' END", "WHERE o_orderstatus IN ('F', 'P')"),
        ("NET_PRESENT", "CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END", ""),
        ("SMALL_ORDER", "CASE WHEN n_lines IS NULL OR n_lines > 6 OR net > 400000 THEN 'INSUFFICIENT_DATA' WHEN total <= 100000.01 THEN 'PASS' ELSE 'FAIL' END", ""),
        ("ONE_FORM", "CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' WHEN net <= coalesce(recomputed * 1.5, total) + 0.01 THEN 'PASS' ELSE 'FAIL' END", ""),
        ("MUST_READ", "CASE WHEN n_lines <= 7.01 THEN 'PASS' ELSE 'FAIL' END", ""),
    ]
) + ") SELECT * FROM c"


@query(_LADDER_SQL)
def check_ladder(t: Tables) -> DataFrame:
    """Applicability, guards, alternative forms and unreadable operands, each in its place."""
    return run_checks(rulesets.order_binding(t.orders, t.lineitem), ["o_orderkey"], LADDER).select("o_orderkey", "rule", "outcome")


@query(
    "WITH "
    + BOUND
    + """ SELECT o_orderkey, unnest(list_filter([CASE WHEN net IS NULL THEN 'net' END, CASE WHEN n_lines IS NULL THEN 'n_lines' END,
       CASE WHEN recomputed IS NULL THEN 'recomputed' END], lambda x: x IS NOT NULL)) AS role FROM b"""
)
def omitted_roles(t: Tables) -> DataFrame:
    """One finding for each role that an order lacks."""
    return omissions(rulesets.order_binding(t.orders, t.lineitem), "o_orderkey", ["net", "n_lines", "recomputed"])


@query(
    "WITH " + BOUND + """,
i AS (SELECT o_orderkey, net, floor(net * 100 + 0.5) / 100 AS subtotal, recomputed - discounted AS tax, net - discounted AS discount, total, n_lines FROM b)
SELECT o_orderkey, CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(subtotal - net) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS sum_int,
       CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(total - (subtotal + tax - abs(discount))) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS total_int,
       CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(tax - subtotal * 0.04) <= 1.0 THEN 'PASS' ELSE 'FAIL' END AS tax_int
FROM i"""
)
def invoice_laws(t: Tables) -> DataFrame:
    """The three laws of an invoice on every order, one column each."""
    b = rulesets.order_binding(t.orders, t.lineitem)
    bound = b.select(
        "o_orderkey", "total", F.col("net").alias("lines_sum"), (F.floor(F.col("net") * 100 + 0.5) / 100).alias("subtotal"),
        (F.col("recomputed") - F.col("discounted")).alias("tax"), (F.col("net") - F.col("discounted")).alias("discount"), F.lit(0.04).alias("tax_rate"),
    )
    claims = run_checks(bound, ["o_orderkey"], rulesets.INVOICE)
    wide = claims.groupBy("o_orderkey").pivot("rule", ["SUM_INT", "TOTAL_INT", "TAX_INT"]).agg(F.first("outcome"))
    return wide.select("o_orderkey", F.col("SUM_INT").alias("sum_int"), F.col("TOTAL_INT").alias("total_int"), F.col("TAX_INT").alias("tax_int"))


_PAY_SQL = """
WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS app FROM orders),
i AS (SELECT o_custkey, app, l_returnflag AS item, sum(l_extendedprice::DECIMAL(18,2)) AS this, sum(l_quantity::DECIMAL(18,2)) AS stored
      FROM lineitem JOIN a ON o_orderkey = l_orderkey GROUP BY ALL),
g AS (SELECT *, sum(this + stored) OVER (PARTITION BY o_custkey, item ORDER BY app ROWS UNBOUNDED PRECEDING) AS g,
             sum(this + 1000) OVER (PARTITION BY o_custkey, item) AS c FROM i),
l AS (SELECT *, lag(g) OVER (PARTITION BY o_custkey, item ORDER BY app) AS d FROM g)
"""


@query(
    _PAY_SQL
    + """, r AS (SELECT *, c::DOUBLE AS cd, g::DOUBLE AS gd, coalesce(d::DOUBLE, 0) AS dd, this::DOUBLE AS e, stored::DOUBLE AS f,
    (c - g + CASE WHEN app % 7 = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS h, floor(g::DOUBLE / c::DOUBLE * 100 + 0.5) / 100 AS p FROM l),
o AS (
  SELECT 'G703_TOTAL' AS rule, abs(gd - (dd + e + f)) <= 0.01 AS ok FROM r UNION ALL SELECT 'G703_BAL', abs(h - (cd - gd)) <= 0.01 FROM r
  UNION ALL SELECT 'G703_PCT', abs(p - gd / cd) <= 0.005 FROM r UNION ALL SELECT 'G703_CAP', gd <= cd + 0.01 FROM r
  UNION ALL SELECT 'G703_PREV', abs(dd - d::DOUBLE) <= 0.01 FROM r WHERE d IS NOT NULL)
SELECT rule, CASE WHEN ok IS NULL THEN 'INSUFFICIENT_DATA' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM o GROUP BY ALL"""
)
def pay_line_laws(t: Tables) -> DataFrame:
    """The line laws of payment applications, counted by outcome."""
    lines, _ = rulesets.pay_applications(t.orders, t.lineitem)
    return run_checks(lines, ["o_custkey"], rulesets.PAY_LINES).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@query(
    _PAY_SQL
    + """, s AS (SELECT o_custkey, app, sum(c)::DOUBLE AS sc, sum(g)::DOUBLE AS sg, (sum(g) * 0.10)::DOUBLE AS kept, (sum(g) - sum(g) * 0.10)::DOUBLE AS earned FROM l GROUP BY ALL),
p AS (SELECT *, lag(earned) OVER (PARTITION BY o_custkey ORDER BY app) AS pe FROM s),
h AS (SELECT *, sc - 500 + CASE WHEN app % 7 = 0 THEN 10 ELSE 0 END AS original, 500 + CASE WHEN app % 6 = 0 THEN 25 ELSE 0 END AS changes, sc + CASE WHEN app % 7 = 0 THEN 10 ELSE 0 END AS contract, sg + CASE WHEN app % 8 = 0 THEN 1 ELSE 0 END AS done,
  coalesce(pe + CASE WHEN app % 9 = 0 THEN 2 ELSE 0 END, 0) AS earlier, earned - coalesce(pe, 0) + CASE WHEN app % 5 = 0 THEN 0.05 ELSE 0 END AS due FROM p),
o AS (
  SELECT 'G702_CSUM' AS rule, abs(contract - (original + changes)) <= 0.01 AS ok FROM h UNION ALL SELECT 'G702_SOV', abs(contract - sc) <= 0.01 FROM h UNION ALL SELECT 'G702_DONE', abs(done - sg) <= 0.01 FROM h
  UNION ALL SELECT 'G702_RATE', abs(kept - done * 0.1) <= 0.01 FROM h UNION ALL SELECT 'G702_EARN', abs(earned - (done - kept)) <= 0.01 FROM h
  UNION ALL SELECT 'G702_DUE', abs(due - (earned - earlier)) <= 0.01 FROM h UNION ALL SELECT 'G702_BAL', abs((sc - earned) - (contract - earned)) <= 0.01 FROM h
  UNION ALL SELECT 'G702_PREV', abs(earlier - pe) <= 0.01 FROM h WHERE pe IS NOT NULL)
SELECT rule, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM o GROUP BY ALL"""
)
def pay_header_laws(t: Tables) -> DataFrame:
    """The header laws of payment applications, counted by outcome."""
    _, head = rulesets.pay_applications(t.orders, t.lineitem)
    return run_checks(head, ["o_custkey"], rulesets.PAY_HEADER).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@query(
    "WITH " + BOUND + """,
v AS (SELECT l_orderkey, count(DISTINCT l_linestatus) AS n_currencies, sum(CASE WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice::DECIMAL(18,4) * l_tax::DECIMAL(18,4) END)::DOUBLE AS s,
             count(*) FILTER (WHERE l_tax = 0.08) AS lost, sum(abs(l_extendedprice::DECIMAL(18,4) - round((l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4))::DECIMAL(9,4))::DECIMAL(20,8), 2)))::DOUBLE AS dev
      FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_orderkey, net, net - discounted AS allowance, discounted, recomputed, recomputed - discounted AS vat, total, n_currencies,
             CASE WHEN lost = 0 THEN s END AS vat_sum, dev, o_custkey FROM b LEFT JOIN v ON l_orderkey = o_orderkey),
o AS (
  SELECT 'LINES_SUM_INT' AS rule, abs(net - net) <= 0.01 AS ok FROM e UNION ALL SELECT 'TAX_EXCL_INT', abs(discounted - (net - coalesce(allowance, 0))) <= 0.01 FROM e
  UNION ALL SELECT 'TAX_INCL_INT', abs(recomputed - (discounted + vat)) <= 0.01 FROM e UNION ALL SELECT 'PAYABLE_INT', abs(total - recomputed) <= 0.01 FROM e
  UNION ALL SELECT 'R120_SUM', dev <= 0.02 FROM e UNION ALL SELECT 'BUYER_REFERENCE', CASE WHEN o_custkey % 11 <> 0 THEN true END FROM e
  UNION ALL SELECT 'BRCO14_VAT_SUM', CASE WHEN vat_sum IS NULL THEN false ELSE abs(vat - vat_sum) <= 0.01 END FROM e
  UNION ALL SELECT 'R051_CURRENCY', n_currencies = 1 FROM e)
SELECT rule, CASE WHEN ok IS NULL THEN 'INSUFFICIENT_DATA' WHEN ok THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM o GROUP BY ALL"""
)
def e_invoice_laws(t: Tables) -> DataFrame:
    """The footing, presence, currency and tax rules of electronic invoices, counted by outcome."""
    price, tax = F.col("l_extendedprice").cast("decimal(18,4)"), F.col("l_tax").cast("decimal(18,4)")
    net = F.round(price * (1 - F.col("l_discount").cast("decimal(18,4)")), 2)
    lost = F.col("l_tax") == 0.08
    v = t.lineitem.groupBy("l_orderkey").agg(
        F.countDistinct("l_linestatus").alias("n_currencies"), F.when(F.count_if(lost) == 0, F.sum(price * tax)).cast("double").alias("vat_sum"),
        F.sum(F.abs(price - net)).cast("double").alias("line_deviation"),
    )
    b = rulesets.order_binding(t.orders, t.lineitem).join(v, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    bound = b.select(
        "o_orderkey", "net", F.col("net").alias("lines_net"), (F.col("net") - F.col("discounted")).alias("allowance"), F.lit(None).cast("double").alias("charge"),
        F.col("discounted").alias("tax_exclusive"), F.col("recomputed").alias("tax_inclusive"), (F.col("recomputed") - F.col("discounted")).alias("vat"),
        F.col("total").alias("payable"), F.lit(None).cast("double").alias("prepaid"), F.lit(None).cast("double").alias("rounding"), "line_deviation",
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("buyer"), "vat_sum", "n_currencies",
    )
    return run_checks(bound, ["o_orderkey"], rulesets.E_INVOICE).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@query(
    FOOTING_SQL
    + """, r AS (SELECT c.*, o.o_orderstatus = 'F' AS bad, right(o.o_orderpriority, 1) AS grp FROM c JOIN orders o USING (o_orderkey)),
k AS (SELECT rule, count(*) FILTER (WHERE outcome = 'FAIL' AND bad) AS tp, count(*) FILTER (WHERE outcome = 'PASS' AND NOT bad) AS tn,
  count(*) FILTER (WHERE outcome = 'FAIL' AND NOT bad) AS fp, count(*) FILTER (WHERE outcome = 'PASS' AND bad) AS fn,
  count(*) FILTER (WHERE outcome = 'INSUFFICIENT_DATA') AS abstained FROM r GROUP BY rule)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)::DOUBLE AS accuracy,
  coalesce(fp / nullif(fp + tn, 0), 0)::DOUBLE AS false_alarm_rate, coalesce((tp + tn + fp + fn) / nullif(tp + tn + fp + fn + abstained, 0), 0)::DOUBLE AS coverage FROM k"""
)
def ruleset_measurement(t: Tables) -> DataFrame:
    """How the footing rules do against a label (orders of status F count as bad)."""
    labelled = footing(t).join(t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("bad")), "o_orderkey")
    return confusion(labelled, ["rule"], "outcome", F.col("bad"))


@query(
    "WITH " + BOUND + """,
s AS (SELECT CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' WHEN total >= net - 0.01 THEN 'PASS' ELSE 'FAIL' END AS old_outcome,
             CASE WHEN net IS NULL THEN 'INSUFFICIENT_DATA' WHEN total >= net * 0.9 - 0.01 THEN 'PASS' ELSE 'FAIL' END AS new_outcome FROM b)
SELECT old_outcome, new_outcome, count(*) AS n FROM s GROUP BY ALL"""
)
def succession(t: Tables) -> DataFrame:
    """What changes when a rule is replaced: orders by outcome under the old and the new rule."""
    b = rulesets.order_binding(t.orders, t.lineitem)
    old = run_checks(b, ["o_orderkey"], [Check("OLD", ">=", "total", "net")]).select("o_orderkey", F.col("outcome").alias("old_outcome"))
    new = run_checks(b, ["o_orderkey"], [Check("NEW", ">=", "total", "net * 0.9")]).select("o_orderkey", F.col("outcome").alias("new_outcome"))
    return old.join(new, "o_orderkey").groupBy("old_outcome", "new_outcome").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY source),
z AS (SELECT *, 1.6448536269514722 AS z, k / n::DOUBLE AS p FROM l)
SELECT source, n, k, least(greatest(ceil(((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) * 1e12) / 1e12, 0), 1)::DOUBLE AS upper_rate,
       least(greatest(floor(((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) * 1e12) / 1e12, 0), 1)::DOUBLE AS lower_rate FROM z"""
)
def wilson_bounds(t: Tables) -> DataFrame:
    """One-sided bounds on each source's share of toxic documents."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source")
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    return rows.select("source", "n", "k", stats.wilson(F.col("k"), F.col("n")).alias("upper_rate"), stats.wilson(F.col("k"), F.col("n"), upper=False).alias("lower_rate"))


@query()
def exact_bounds(t: Tables) -> DataFrame:
    """Exact one-sided upper bounds on the same shares; SQL has no inverse of the binomial, so tests hold the bound
    against its definition."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source")
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    return rows.select("source", "n", "k", stats.clopper_pearson(F.col("k"), F.col("n")).alias("upper_rate"))
