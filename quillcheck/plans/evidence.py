"""Queries on facts out of markup and text, and on what is due and agreed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import FAIL, OPEN, PASS, outcome
from ..operators import ledger, markup
from .claims import FOOTING_SQL, footing
from .registry import Tables, query


@query(
    """WITH c AS (SELECT o_orderkey, unnest([o_custkey % 900 + 1, o_custkey % 50 + 1])::INT AS volume, unnest(['F.3d', 'U.S.']) AS reporter, unnest([o_orderkey % 2000 + 1, o_orderkey % 7 + 1])::INT AS page FROM orders)
SELECT o_orderkey, volume, reporter, page, CASE WHEN reporter = 'U.S.' THEN 'INSUFFICIENT_DATA' WHEN page <= 1500 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM c"""
)
def brief_citations(t: Tables) -> DataFrame:
    """Citations read from briefs, held against the reporter whose volumes are at hand (pages up to 1,500)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    brief = F.concat(F.lit("See A v. B, "), s(c % 900 + 1), F.lit(" F.3d "), s(k % 2000 + 1), F.lit(", 12 (9th Cir. 1999); cf. "), s(c % 50 + 1), F.lit(" U.S. "), s(k % 7 + 1), F.lit("."))
    found = markup.citations(t.orders.select("o_orderkey", brief.alias("brief")), ["o_orderkey"], "brief")
    known = t.spark.createDataFrame([("F.3d", 1500)], "reporter string, last_page int")
    rows = found.join(F.broadcast(known), "reporter", "left")  # one row
    return rows.select("o_orderkey", "volume", "reporter", "page", outcome(F.col("page") <= F.col("last_page")).alias("outcome"))


@query(
    """SELECT o_orderkey, concept, context, 'USD' AS unit, value FROM (SELECT o_orderkey, unnest(['us:Revenue', 'us:Loss', 'us:Other', 'us:Note']) AS concept, 'c' || (o_orderkey % 4) AS context,
  unnest([floor(o_totalprice) * 1000, -floor(o_totalprice), 0, NULL])::DOUBLE AS value FROM orders)"""
)
def inline_facts(t: Tables) -> DataFrame:
    """Numeric facts read from inline markup, by scale and sign; one is a dash, one no number."""
    shown = F.format_number(F.floor("o_totalprice"), 0)
    tag = lambda name, more, text: F.concat(
        F.lit(f'<td><ix:nonFraction name="{name}" contextRef="c'), (F.col("o_orderkey") % 4).cast("string"), F.lit(f'" unitRef="USD"{more}>'), text, F.lit("</ix:nonFraction></td>")
    )
    html = F.concat(
        F.lit("<html><p>text</p>"), tag("us:Revenue", ' scale="3" decimals="-3"', shown), tag("us:Loss", ' sign="-"', shown), tag("us:Other", "", F.lit("—")), tag("us:Note", "", F.lit("see note"))
    )
    return markup.numeric_facts(t.orders.select("o_orderkey", html.alias("html")), ["o_orderkey"], "html")


@query(
    """SELECT o_orderkey, 'INV-' || o_orderkey AS number, CASE WHEN o_orderkey % 5 <> 0 THEN 'PO' || o_custkey END AS po, o_totalprice::DECIMAL(18,2)::DOUBLE AS total, 2 AS n_lines, (3 * (o_custkey + 0.5) + 2 * 1000.25)::DOUBLE AS lines_sum,
  'PASS' AS line_math FROM orders"""
)
def mailed_bills(t: Tables) -> DataFrame:
    """Bills read from mail text, and whether every line's quantity times price is its amount."""
    c = F.col("o_custkey")
    price, amount = F.concat(c.cast("string"), F.lit(".50")), F.format_number(3 * (c + 0.5), 2)
    mail = F.concat(
        F.lit("Dear all,\nInvoice No: INV-"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("\nPO: PO"), c.cast("string"))).otherwise(""),
        F.lit("\nsmall ring  3 @ "), price, F.lit(" = "), amount, F.lit("\nred widget  2 @ 1,000.25 = 2,000.50\nTotal due: $"),
        F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit("\nThanks"),
    )
    rows = markup.bill_fields(t.orders.select("o_orderkey", mail.alias("mail")), ["o_orderkey"], "mail")
    sums = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["amount"])
    exact = F.forall("lines", lambda x: F.abs(x["quantity"] * x["price"] - x["amount"]) <= 0.01)
    return rows.select("o_orderkey", "number", "po", "total", F.size("lines").alias("n_lines"), sums.alias("lines_sum"), outcome(exact).alias("line_math"))


@query(
    """WITH c AS (SELECT n_nationkey, n_regionkey, n_nationkey % 4 AS k FROM nation) SELECT n_nationkey, CASE k WHEN 3 THEN NULL WHEN 1 THEN 0 ELSE n_nationkey END AS passed, CASE k WHEN 3 THEN NULL WHEN 0 THEN 0 ELSE n_regionkey END AS failed,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS n_claims, CASE WHEN k IN (0, 2) THEN CASE WHEN k = 0 THEN 'SUPPORTED' WHEN n_regionkey = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END ELSE 'NO_CLAIM' END AS support FROM c"""
)
def done_claims(t: Tables) -> DataFrame:
    """Claims of being done against the test output before them; hedged sentences claim nothing."""
    k, n, r = F.col("n_nationkey") % 4, F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    output = F.when(k == 0, F.concat(n, F.lit(" passed in 3s"))).when(k == 1, F.concat(r, F.lit(" failed"))).when(k == 2, F.concat(F.lit("1 failed, 2 passed\n"), r, F.lit(" failed, "), n, F.lit(" passed"))).otherwise("no summary")
    said = F.when(k == 0, "I looked at it. All tests pass.").when(k == 1, "It should be fixed once merged.").when(k == 2, "The bug is fixed! Thanks.").otherwise("It is not done.")
    rows = t.nation.select("n_nationkey", markup.run_counts(output).alias("c"), F.size(markup.done_claims(said)).alias("n_claims"))
    support = F.when(F.col("n_claims") == 0, "NO_CLAIM").when(F.col("c.failed") > 0, "CONTRADICTED").when(F.col("c").isNull(), "NO_EVIDENCE").otherwise("SUPPORTED")
    return rows.select("n_nationkey", F.col("c.passed").alias("passed"), F.col("c.failed").alias("failed"), "n_claims", support.alias("support"))


@query(
    FOOTING_SQL
    + """ SELECT rule, count(*) AS reviewed, count(*) FILTER (WHERE upheld) AS upheld, count(*) FILTER (WHERE NOT upheld) AS overturned, count(*) FILTER (WHERE NOT upheld)::DOUBLE / count(*) AS overturn_rate
FROM (SELECT rule, o.o_orderpriority <> '1-URGENT' AS upheld FROM c JOIN orders o USING (o_orderkey) WHERE outcome = 'FAIL') GROUP BY rule"""
)
def rule_calibration(t: Tables) -> DataFrame:
    """Per rule how many failed claims later review overturned (urgent orders stand for overturned ones)."""
    failed = footing(t).where(F.col("outcome") == FAIL).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    upheld = F.col("o_orderpriority") != "1-URGENT"
    out = failed.groupBy("rule").agg(F.count("*").alias("reviewed"), F.count_if(upheld).alias("upheld"), F.count_if(~upheld).alias("overturned"))
    return out.withColumn("overturn_rate", F.try_divide("overturned", "reviewed"))


@query(
    """WITH a AS (SELECT o_custkey AS who, o_orderkey AS k, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE year(o_orderdate) * 12 + month(o_orderdate) END AS n FROM orders), g AS (SELECT who, count(*) AS c, count(n) AS known, max(n) AS top FROM a GROUP BY who),
m AS (SELECT g.*, (SELECT count(*) FROM a WHERE a.who = g.who AND a.n = g.top) AS ties, (SELECT min(k) FROM a WHERE a.who = g.who AND a.n = g.top) AS best, (SELECT min(k) FROM a WHERE a.who = g.who) AS sole FROM g)
SELECT who, CASE WHEN c = 1 THEN sole WHEN known = c AND ties = 1 THEN best END AS previous, CASE WHEN c = 1 OR (known = c AND ties = 1) THEN 'FOUND' ELSE 'AMBIGUOUS_REFERENCE' END AS status FROM m"""
)
def previous_application(t: Tables) -> DataFrame:
    """The document that a customer's next one continues: the only one, else that of the highest number; ambiguous if a
    number is missing or the highest stands twice."""
    n = F.when(F.col("o_orderkey") % 19 != 0, F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    rows = t.orders.select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("k"), n.alias("n"))
    tied = rows.groupBy("who", "n").agg(F.count("*").alias("c"), F.min("k").alias("k"))
    out = tied.groupBy("who").agg(F.sum("c").alias("c"), F.count_if(F.col("n").isNull()).alias("lost"), F.max(F.struct("n", F.col("c").alias("ties"), "k")).alias("top"), F.min("k").alias("only"))
    sound = (F.col("lost") == 0) & (F.col("top.ties") == 1)
    found = F.when(F.col("c") == 1, F.col("only")).when(sound, F.col("top.k"))
    return out.select("who", found.alias("previous"), F.when(found.isNotNull(), "FOUND").otherwise("AMBIGUOUS_REFERENCE").alias("status"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'identical' WHEN p_partkey % 4 = 1 THEN 'equivalent' WHEN p_partkey % 4 = 2 THEN 'different' END AS amount, CASE WHEN p_partkey % 4 = 0 THEN 'identical' WHEN p_partkey % 4 = 1 THEN 'equivalent' ELSE 'different' END AS identifier FROM part"""
)
def typed_equivalence(t: Tables) -> DataFrame:
    """Values that say the same though written otherwise: prices and brand names."""
    k = F.col("p_partkey") % 4
    price = F.col("p_retailprice").cast("decimal(18,2)")
    plain, dressed = price.cast("string"), F.concat(F.lit("$"), F.format_number(price, 2))
    other = F.when(k == 0, plain).when(k == 1, dressed).when(k == 2, (price + 1).cast("string")).otherwise("on request")
    brand = F.col("p_brand")
    spelled = F.when(k == 0, brand).when(k == 1, F.lower(F.regexp_replace(brand, "#", " - "))).otherwise(F.concat(brand, F.lit("x")))
    return t.part.select("p_partkey", markup.equivalence(plain, other, "amount").alias("amount"), markup.equivalence(brand, spelled, "identifier").alias("identifier"))


@query(
    """WITH p AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, lead(period) OVER (PARTITION BY user_id ORDER BY period) IS NOT NULL AS closed FROM p), d AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS period FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS n_due FROM c WHERE closed AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = c.user_id AND d.period = c.period) GROUP BY user_id"""
)
def samples_due(t: Tables) -> DataFrame:
    """Closed periods without a committed draw (an error event stands for one), by user."""
    at = F.col("ts").cast("timestamp")
    events = t.events.select("event_id", "user_id", "event_type", at.alias("at"))
    closed = ledger.close_periods(ledger.chain_periods(events, ["user_id"], "event_id", "at", "day"), ["user_id"], "event_id").where("closed_by is not null")
    draws = events.where("event_type = 'error'").select("user_id", F.date_trunc("day", "at").alias("period")).distinct()
    return closed.join(draws, ["user_id", "period"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n_due"))


@query(
    """WITH r AS (SELECT event_id, event_id % 6 AS k, event_type, value FROM events) SELECT CASE k WHEN 1 THEN 'unknown column' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'no tokens' ELSE 'accepted' END AS reading, count(*) AS n, sum(CASE WHEN k NOT IN (1, 2, 3) THEN floor(value)::BIGINT END)::BIGINT AS tokens FROM r GROUP BY 1"""
)
def usage_exports(t: Tables) -> DataFrame:
    """Usage rows of a provider's export: accepted, or refused with the reason (an unknown column is never ignored)."""
    k, tokens = F.col("event_id") % 6, F.floor("value").cast("long")
    line = F.when(k == 2, F.lit("{oops")).otherwise(
        F.concat(F.lit('{"model":"'), F.col("event_type"), F.lit('"'), F.when(k != 3, F.concat(F.lit(',"tokens":'), tokens.cast("string"))).otherwise(""), F.when(k == 1, ',"extra":1').otherwise(""), F.lit("}"))
    )
    rows = t.events.select(line.alias("line")).select(F.from_json("line", "map<string,string>").alias("m"))
    unknown = F.size(F.array_except(F.map_keys("m"), F.array(F.lit("model"), F.lit("tokens")))) > 0
    reading = F.when(F.col("m").isNull() | (F.size("m") == 0), "not JSON").when(unknown, "unknown column").when(F.col("m")["tokens"].try_cast("long").isNull(), "no tokens").otherwise("accepted")
    read = rows.select(reading.alias("reading"), F.col("m")["tokens"].try_cast("long").alias("tokens"))
    return read.groupBy("reading").agg(F.count("*").alias("n"), F.sum(F.when(F.col("reading") == "accepted", F.col("tokens"))).alias("tokens"))


@query(
    """SELECT p_type, list_sort(list(DISTINCT lower(p_brand)))[1] AS first_brand, count(*) AS n, CASE WHEN count(*) > 10 THEN 'PASS' WHEN count(*) > 5 THEN 'INSUFFICIENT_DATA' ELSE 'FAIL' END AS rung FROM part GROUP BY p_type"""
)
def voice_rungs(t: Tables) -> DataFrame:
    """Which rung of a policy the number of cases behind each type supports."""
    rows = t.part.groupBy("p_type").agg(F.min(F.lower("p_brand")).alias("first_brand"), F.count("*").alias("n"))
    return rows.withColumn("rung", F.when(F.col("n") > 10, PASS).when(F.col("n") > 5, OPEN).otherwise(FAIL))
