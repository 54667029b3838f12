"""Queries of the decision layer: labels, taxes, bars, policies, audits and quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.outcome import OPEN, outcome, worst
from ..operators import decisions
from .registry import Tables, query


@query(
    """WITH c AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'INSUFFICIENT_DATA' WHEN l_extendedprice >= 1500 THEN 'PASS' ELSE 'FAIL' END AS o, l_returnflag = 'R' AND l_tax = 0 AND l_discount = 0 AS suspect, l_quantity <= 1 AND l_linestatus = 'F' AS struck FROM lineitem),
v AS (SELECT l_orderkey, count(*) FILTER (WHERE o = 'FAIL') AS f, count(*) FILTER (WHERE o = 'PASS') AS p, count(*) FILTER (WHERE o = 'INSUFFICIENT_DATA') AS u, count(*) FILTER (WHERE suspect) AS s, count(*) FILTER (WHERE struck) AS k FROM c GROUP BY 1)
SELECT l_orderkey, CASE WHEN f > 0 THEN 'FAIL' WHEN s > 0 THEN 'HELD-SUSPECT' WHEN k > 0 THEN 'OPEN' WHEN p > 0 AND u > 0 THEN 'PASS-WITH-OPEN' WHEN p > 0 THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS label FROM v"""
)
def gate_labels(t: Tables) -> DataFrame:
    """What a person reads of each order whose lines are its claims (lines under 1500 fail)."""
    made = outcome(F.col("l_extendedprice") >= 1500)
    claim = F.when(F.expr("l_linestatus = 'O' and l_returnflag = 'A'"), OPEN).otherwise(made)
    verdicts = t.lineitem.select("l_orderkey", "l_returnflag", "l_tax", "l_discount", "l_quantity", "l_linestatus", claim.alias("claim")).groupBy("l_orderkey").agg(
        worst(F.col("claim")).alias("verdict"),
        F.expr("count_if(l_returnflag = 'R' and l_tax = 0 and l_discount = 0)").alias("suspects"),
        F.expr("count_if(l_quantity <= 1 and l_linestatus = 'F')").alias("struck"),
        F.count_if(F.col("claim") == OPEN).alias("unknown"),
    )
    return verdicts.select("l_orderkey", decisions.gate_label(*(F.col(c) for c in ("verdict", "suspects", "struck", "unknown"))).alias("label"))


@query(
    """WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_tax, l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) AS net FROM lineitem),
l AS (SELECT l_orderkey, arg_min(l_tax, (l_linenumber, l_partkey, l_suppkey, l_tax)) AS rate, round(sum(net * l_tax::DECIMAL(4,2)), 2)::DOUBLE AS tax, coalesce(sum(net) FILTER (WHERE l_returnflag <> 'R'), 0)::DOUBLE AS base, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM d GROUP BY 1),
r AS (SELECT o_orderkey, tax, CASE WHEN o_orderpriority NOT LIKE '4%' THEN rate END AS rate, base, n FROM orders JOIN l ON l_orderkey = o_orderkey),
s AS (SELECT o_orderkey, tax, rate, CASE WHEN abs(tax) < 0.005 THEN 'no tax billed' WHEN tax < 0 THEN 'negative tax' WHEN rate IS NULL THEN 'no tax terms' WHEN rate = 0 THEN 'no tax due' WHEN abs(tax - rate * base) <= 0.01 * greatest(n, 1) + 1e-9 THEN 'as stated' ELSE 'off the stated rate' END AS reason FROM r)
SELECT o_orderkey, tax, rate, reason, CASE reason WHEN 'no tax billed' THEN 'PASS' WHEN 'as stated' THEN 'PASS' WHEN 'no tax due' THEN 'FAIL' ELSE 'INSUFFICIENT_DATA' END AS outcome FROM s"""
)
def tax_claims(t: Tables) -> DataFrame:
    """The tax of an order's lines against the rate of its first line, returned lines not taxed; unspecified orders state none."""
    net, taxed = F.expr("cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"), F.col("l_returnflag") != "R"
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax"))["l_tax"].alias("first_rate"), F.round(F.sum(net * F.col("l_tax").cast("decimal(4,2)")), 2).cast("double").alias("tax"),
        F.coalesce(F.sum(F.when(taxed, net)).cast("double"), F.lit(0.0)).alias("base"), F.count_if(taxed).alias("n"),
    )
    rows = t.orders.select("o_orderkey", "o_orderpriority").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("rate", F.when(~F.col("o_orderpriority").startswith("4"), F.col("first_rate")))
    claim = decisions.tax_due(F.col("tax"), F.col("rate"), F.col("base"), F.col("n"))
    return rows.select("o_orderkey", "tax", "rate", claim.alias("claim")).select("o_orderkey", "tax", "rate", "claim.*")


@query(
    """WITH f AS (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS flow FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND flow > 0 THEN least(0.05, s_acctbal / flow) END AS bar FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey)
SELECT s_suppkey, round(bar, 12) AS bar, greatest(1, ceil(ln(0.05) / ln(1 - bar) - 1e-9))::BIGINT AS zero_miss FROM b WHERE bar IS NOT NULL"""
)
def money_bars(t: Tables) -> DataFrame:
    """Per supplier the error rate that its balance tolerates over what it delivered, and how many clean cases show it."""
    flow = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("flow"))
    rows = t.supplier.select("s_suppkey", "s_acctbal").join(flow, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    rows = rows.select("s_suppkey", decisions.money_bar(F.col("s_acctbal"), F.col("flow")).alias("bar")).where("bar is not null")
    return rows.select("s_suppkey", F.round("bar", 12).alias("bar"), stats.zero_miss_size(F.col("bar")).alias("zero_miss"))


@query(
    """WITH t AS (SELECT l_suppkey AS policy, l_linenumber AS tier, count(*) FILTER (WHERE l_returnflag = 'R') AS min_n, (sum((l_discount * 100)::INT) / (count(*) * 100.0::DOUBLE))::DOUBLE AS max_error FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, lag(min_n) OVER w AS n0, lag(max_error) OVER w AS e0, CASE WHEN max_error > 0 AND max_error < 1 THEN greatest(1, ceil(ln(0.05) / ln(1 - max_error) - 1e-9))::BIGINT END AS zero_miss FROM t WINDOW w AS (PARTITION BY policy ORDER BY tier))
SELECT policy, tier, min_n, round(max_error, 12) AS max_error, zero_miss, concat_ws('; ', CASE WHEN max_error <= 0 OR max_error >= 1 THEN 'max_error out of range' END, CASE WHEN min_n < n0 THEN 'min_n falls' END, CASE WHEN max_error > e0 THEN 'max_error rises' END, CASE WHEN min_n < zero_miss THEN 'min_n is inert' END) AS findings FROM b"""
)
def policy_lint(t: Tables) -> DataFrame:
    """Suppliers' lines read as policies, a tier a line number: where the burden of proof falls, and minima that cannot work."""
    share = F.sum((F.round(F.col("l_discount") * 100)).cast("int")) / (F.count("*") * F.lit(100.0))
    tiers = t.lineitem.groupBy(F.col("l_suppkey").alias("policy"), F.col("l_linenumber").alias("tier")).agg(F.count_if(F.col("l_returnflag") == "R").alias("min_n"), share.alias("max_error"))
    return decisions.lint_tiers(tiers, "policy", "tier").withColumn("max_error", F.round("max_error", 12))


@query(
    """WITH r AS (SELECT l_suppkey AS workflow, l_shipdate >= TIMESTAMP '1996-06-01' AS drawn, l_quantity >= 48 AS planted, l_linestatus = 'F' AS signed, l_suppkey % 3 = l_orderkey % 3 AS own, l_returnflag <> 'N' AS reviewed, l_returnflag = 'R' AS overturned FROM lineitem),
s AS (SELECT *, CASE WHEN NOT reviewed THEN CASE WHEN drawn AND NOT planted THEN 'untested' END WHEN planted THEN 'planted' WHEN NOT signed THEN 'unsigned' WHEN own THEN 'own work' WHEN NOT drawn THEN 'not drawn' ELSE 'counted' END AS state FROM r),
c AS (SELECT workflow, count(*) FILTER (WHERE state = 'counted') AS n_counted, count(*) FILTER (WHERE state = 'not drawn') AS n_not_drawn, count(*) FILTER (WHERE state = 'own work') AS n_own_work, count(*) FILTER (WHERE state = 'unsigned') AS n_unsigned, count(*) FILTER (WHERE state = 'untested') AS n_untested,
  count(*) FILTER (WHERE state = 'counted' AND overturned) AS n_overturned, count(*) FILTER (WHERE state = 'planted' AND signed AND NOT own) AS n_tests, count(*) FILTER (WHERE state = 'planted' AND signed AND NOT own AND overturned) AS n_caught FROM s GROUP BY 1),
b AS (SELECT *, (n_tests - n_caught) / n_tests::DOUBLE AS p, n_tests AS n, 1.6448536269514722 AS z FROM c)
SELECT workflow, n_counted, n_not_drawn, n_own_work, n_unsigned, n_untested, n_overturned, n_tests, n_caught, CASE WHEN n > 0 THEN round(1 - least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) END AS caught_at_least FROM b"""
)
def review_audit(t: Tables) -> DataFrame:
    """Suppliers' lines read as reviewed cases: which reviews count as evidence, and whether the planted ones were caught."""
    reviews = t.lineitem.select(
        F.col("l_suppkey").alias("workflow"), (F.col("l_shipdate").cast("date") >= F.to_date(F.lit("1996-06-01"))).alias("drawn"), (F.col("l_quantity") >= 48).alias("planted"),
        (F.col("l_linestatus") == "F").alias("signed"), (F.col("l_suppkey") % 3).alias("owner"), F.when(F.col("l_returnflag") != "N", F.col("l_orderkey") % 3).alias("reviewer"),
        (F.col("l_returnflag") == "R").alias("overturned"),
    )
    return decisions.audit_reviews(reviews, ["workflow"]).withColumn("caught_at_least", F.round("caught_at_least", 9))


@query(
    """WITH f AS (SELECT user_id, ts::DATE AS day, event_type, event_type IN ('view', 'purchase') AS uses, event_type = 'click' AS struck, event_type = 'signup' AS missing, value::DECIMAL(18,4) AS v FROM events)
SELECT user_id, day, count(*) FILTER (WHERE uses AND v IS NOT NULL) AS n_used, count(*) FILTER (WHERE NOT uses AND NOT struck AND NOT missing) AS n_held, count(*) FILTER (WHERE struck) AS n_struck, count(*) FILTER (WHERE missing OR (uses AND v IS NULL)) AS n_absent,
  CASE WHEN count(*) FILTER (WHERE NOT uses AND NOT struck AND NOT missing) = 0 THEN (sum(v) FILTER (WHERE uses))::DOUBLE END AS total FROM f GROUP BY 1, 2"""
)
def flagged_values(t: Tables) -> DataFrame:
    """Events summed by user and day, their kind read as a quality flag: some compute, some are struck or absent, any other holds the sum."""
    policy = {"compute": ("view", "purchase"), "strike": ("click",), "absent": ("signup",)}
    found = decisions.by_flag(F.col("event_type"), F.col("value").cast("decimal(18,4)"), policy)
    rows = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(*[c.alias(n) for n, c in found.items()])
    return rows.withColumn("total", F.col("total").cast("double"))


@query(
    """SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_pass, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_fail, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS n_open, count(*) FILTER (WHERE o_orderpriority < '3') AS n_reviewed,
  coalesce(count(*) FILTER (WHERE o_orderpriority < '2') / nullif(count(*) FILTER (WHERE o_orderpriority < '3'), 0)::DOUBLE, 0) AS overturn_rate, max(o_orderpriority) AS evidence_floor FROM orders GROUP BY 1"""
)
def ledger_stats(t: Tables) -> DataFrame:
    """Per customer the verdicts by outcome, the reviewed ones, the share overturned (0 if none) and the weakest evidence."""
    reviewed = F.count_if(F.col("o_orderpriority") < "3")
    return t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_pass"), F.count_if(F.col("o_orderstatus") == "F").alias("n_fail"),
        F.count_if(~F.col("o_orderstatus").isin("O", "F")).alias("n_open"), reviewed.alias("n_reviewed"),
        F.coalesce(F.try_divide(F.count_if(F.col("o_orderpriority") < "2"), reviewed), F.lit(0.0)).alias("overturn_rate"), F.max("o_orderpriority").alias("evidence_floor"),
    )
