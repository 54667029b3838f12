"""Queries on binding, alignment, grounding, diagnosis and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.outcome import FAIL, OPEN, PASS, outcome
from ..operators import binding
from .registry import Tables, query


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice WHEN 2 THEN 0 END AS total,
  CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'defaulted' ELSE 'unparseable' END AS status, CASE o_orderkey % 6 WHEN 0 THEN '$.total' WHEN 1 THEN '$.summary.grand_total' WHEN 2 THEN NULL ELSE '$.total' END AS path FROM orders"""
)
def field_binding(t: Tables) -> DataFrame:
    """Totals bound from JSON documents by candidate paths: read, defaulted, or seen and not read."""
    k, v = F.col("o_orderkey") % 6, F.col("o_totalprice").cast("string")
    doc = (
        F.when(k == 0, F.concat(F.lit('{"total":'), v, F.lit("}"))).when(k == 1, F.concat(F.lit('{"summary":{"grand_total":'), v, F.lit("}}")))
        .when(k == 2, F.lit('{"other":1}')).when(k == 3, F.lit('{"total":"UNREADABLE"}')).when(k == 4, F.lit('{"total":""}')).otherwise(F.lit('{"total":null}'))
    )
    rows = t.orders.select("o_orderkey", F.try_parse_json(doc).alias("d"))
    bound = binding.bind(F.col("d"), ["$.total", "$.summary.grand_total"], "double", 0.0)
    return rows.select("o_orderkey", bound.alias("b")).select("o_orderkey", F.col("b.value").alias("total"), "b.status", "b.path")


@query("SELECT event_id, '$.k' AS path, props->>'$.k' AS value FROM events")
def json_leaves(t: Tables) -> DataFrame:
    """Every leaf of the events' properties by its path."""
    rows = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return rows.select("event_id", F.concat(F.lit("$."), "name").alias("path"), "value")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 = 2 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END AS day_read, 
  CASE WHEN o_orderkey % 7 IN (1, 2) THEN day(d) <= 12 AND day(d) <> month(d) ELSE false END AS ambiguous FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""
)
def dates_read(t: Tables) -> DataFrame:
    """Dates read back from seven ways of writing them; day-first ones up to the twelfth read month-first, and say so."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    raw = F.lit("soon")
    for i, pattern in enumerate(("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyyMMdd", "d MMMM yyyy", "MMMM d, yyyy")):
        raw = F.when(k == i, F.date_format(d, pattern)).otherwise(raw)
    rows = t.orders.select("o_orderkey", binding.read_date(raw).alias("r"))
    return rows.select("o_orderkey", F.col("r.date").alias("day_read"), "r.ambiguous")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN -6 WHEN 3 THEN 9 END::INT AS power, o_orderkey % 5 = 4 AND substr(w, 1, 1) <> substr(w, 2, 1) AS swapped
FROM (SELECT *, floor(o_totalprice)::BIGINT::VARCHAR AS w FROM orders WHERE o_totalprice > 100)"""
)
def misread_amounts(t: Tables) -> DataFrame:
    """What is wrong with amounts that miss a fact: a scale of ten, or two digits swapped."""
    fact, k = F.floor("o_totalprice").cast("double"), F.col("o_orderkey") % 5
    value = F.when(k == 0, fact).when(k == 1, fact * 1e3).when(k == 2, fact * 1e-6).when(k == 3, fact * 1e9).otherwise(fact * 1.7)
    a = F.floor("o_totalprice").cast("long").cast("string")
    b = F.when(k == 4, F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.expr("substring(cast(cast(floor(o_totalprice) as bigint) as string), 3)"))).otherwise(a)
    rows = t.orders.where("o_totalprice > 100")
    return rows.select("o_orderkey", binding.scale_between(value, fact).alias("power"), binding.one_swap(a, b).alias("swapped"))


@query(
    """WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS item, l_extendedprice AS ord FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_extendedprice) = 1),
b AS (SELECT * FROM a WHERE ord < 80000), u AS (SELECT doc, count(*) = count(DISTINCT item) AS ua FROM a GROUP BY doc), v AS (SELECT doc, count(*) = count(DISTINCT item) AS ub FROM b GROUP BY doc),
s AS (SELECT coalesce(u.doc, v.doc) AS doc, coalesce(ua, true) AND coalesce(ub, true) AS by_item FROM u FULL JOIN v ON u.doc = v.doc),
x AS (SELECT a.*, CASE WHEN by_item THEN 'i' || item ELSE 'p' || row_number() OVER (PARTITION BY doc ORDER BY ord) END AS k FROM a JOIN s USING (doc)),
y AS (SELECT b.*, CASE WHEN by_item THEN 'i' || item ELSE 'p' || row_number() OVER (PARTITION BY doc ORDER BY ord) END AS k FROM b JOIN s USING (doc))
SELECT coalesce(x.doc, y.doc) AS doc, x.item AS a_item, x.ord AS a_order, y.item AS b_item, y.ord AS b_order FROM x FULL JOIN y ON x.doc = y.doc AND x.k = y.k"""
)
def line_alignment(t: Tables) -> DataFrame:
    """Two readings of the same lines side by side, by number where numbers are unique, else by place."""
    same = F.count("*").over(W.partitionBy("l_orderkey", "l_extendedprice"))
    a = t.lineitem.withColumn("_c", same).where("_c = 1")
    a = a.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item"), F.col("l_extendedprice").alias("ord"))
    return binding.align(a, a.where("ord < 80000"), "doc", "item", "ord")


@query(
    """WITH q AS (SELECT p_partkey, p_name, p_brand FROM part), w AS (SELECT p_partkey, p_name, p_brand, p_size, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda x: len(x) > 2)) AS l FROM part),
c AS (SELECT q.p_partkey AS line, b.p_partkey AS evidence, CASE WHEN least(len(a.l), len(b.l)) > 0 THEN len(list_intersect(a.l, b.l)) / least(len(a.l), len(b.l))::DOUBLE ELSE 0 END AS score
  FROM q JOIN w a ON a.p_partkey = q.p_partkey JOIN w b ON b.p_brand = q.p_brand AND b.p_partkey <> q.p_partkey),
m AS (SELECT line, max(score) AS top FROM c GROUP BY line), u AS (SELECT c.line, count(*) AS n, min(evidence) AS evidence, max(score) AS score FROM c JOIN m ON m.line = c.line AND c.score = m.top AND m.top >= 0.25 GROUP BY c.line)
SELECT m.line, u.evidence, u.score FROM m LEFT JOIN u ON u.line = m.line AND u.n = 1"""
)
def evidence_line(t: Tables) -> DataFrame:
    """The one other part of the brand whose name shares most with each part's; a shared best binds nothing."""
    rows = t.part.select(F.col("p_partkey").alias("line"), "p_brand", "p_name")
    return binding.best_by_words(rows, "p_brand", "line", "p_name", 0.25)


@query(
    """WITH a AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) = 1), r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linestatus = 'F')
SELECT k, 2::BIGINT AS n_args, p IN (SELECT p FROM r) AND s IN (SELECT s FROM r) AS every, EXISTS (SELECT 1 FROM r WHERE r.p = a.p AND r.s = a.s) AS together FROM a"""
)
def action_grounding(t: Tables) -> DataFrame:
    """Whether the part and supplier of an order's first line were approved (shipped before), each and together."""
    first = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey"))
    one = t.lineitem.where("l_linenumber = 1").withColumn("_n", first).where("_n = 1")
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in (("p", "l_partkey"), ("s", "l_suppkey"))]))
    args = one.select(F.col("l_orderkey").alias("k"), pairs)
    approved = t.lineitem.where("l_linestatus = 'F'").select("l_partkey", "l_suppkey").distinct()
    records = approved.select(F.concat_ws("/", "l_partkey", "l_suppkey").alias("record"), pairs)
    return binding.grounded(args, records, "k", "record", "name", "value")


@query(
    """WITH c AS (SELECT o_custkey AS volume, o_orderkey AS page FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_custkey AS volume, o_orderkey AS pin FROM orders WHERE o_orderstatus = 'O')
SELECT p.volume, pin, max(page) AS first_page FROM p LEFT JOIN c ON c.volume = p.volume AND c.page <= p.pin GROUP BY ALL"""
)
def short_citations(t: Tables) -> DataFrame:
    """For each pin cite the full cite of its volume whose first page is the last at or before it."""
    both = t.orders.where("o_orderstatus in ('F', 'O')").select(F.col("o_custkey").alias("volume"), F.col("o_orderkey").alias("pin"), (F.col("o_orderstatus") == "F").alias("full"))
    w = W.partitionBy("volume").orderBy("pin").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("first_page", F.last(F.when(F.col("full"), F.col("pin")), True).over(w))
    return found.where(~F.col("full")).select("volume", "pin", "first_page")


@query(
    """WITH f AS (SELECT o_custkey AS who, o_orderdate::DATE AS ends, o_totalprice AS v, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority, o_orderkey AS k FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY priority, abs(ends - DATE '1997-06-30'), k) AS n FROM f WHERE abs(ends - DATE '1997-06-30') <= 30) SELECT who, k AS fact, v AS value, priority::INT AS priority FROM n WHERE n = 1"""
)
def period_facts(t: Tables) -> DataFrame:
    """For each customer the fact for a period end: within thirty days, by priority of concept, then nearest."""
    ends = F.to_date(F.lit("1997-06-30"))
    off = F.abs(F.datediff(F.col("o_orderdate").cast("date"), ends))
    priority = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = t.orders.where(off <= 30).select(F.col("o_custkey").alias("who"), F.struct(priority.alias("p"), off.alias("off"), F.col("o_orderkey").alias("k")).alias("s"), F.col("o_totalprice").alias("v"))
    best = rows.groupBy("who").agg(F.min(F.struct("s", "v")).alias("b"))
    return best.select("who", F.col("b.s.k").alias("fact"), F.col("b.v").alias("value"), F.col("b.s.p").alias("priority"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'PASS' WHEN o_orderkey % 4 = 1 AND o_orderdate::DATE <= DATE '2030-01-01' THEN 'PASS' ELSE 'FAIL' END AS outcome FROM orders"""
)
def model_names(t: Tables) -> DataFrame:
    """Whether a resolved name is the expected one, or it with a real date not after the day of the reply."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    resolved = F.when(k == 0, "base-1").when(k == 1, F.concat(F.lit("base-1-"), F.date_format(day, "yyyyMMdd"))).when(k == 2, "base-1-20269999").otherwise("base-2")
    suffix = F.regexp_extract(resolved, r"^base-1-([0-9]{8})$", 1)
    dated = F.coalesce(F.try_to_date(suffix, "yyyyMMdd") <= day, F.lit(False))
    return t.orders.select("o_orderkey", outcome((resolved == "base-1") | dated).alias("outcome"))


@query(
    """SELECT event_id, CASE WHEN value < 5 THEN 'CLOSED' WHEN ts + INTERVAL 14 DAY > TIMESTAMP '2024-01-20' THEN 'OPEN' WHEN event_type = 'error' AND value > 30 THEN 'FAIL' ELSE 'UNSUPPORTED' END AS state FROM events"""
)
def case_clock(t: Tables) -> DataFrame:
    """Cases at their deadline: an open one past it is unsupported, or fails if what was disputed still does."""
    due = F.expr("ts + INTERVAL 14 DAY") > F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    late = F.when((F.col("event_type") == "error") & (F.col("value") > 30), FAIL).otherwise("UNSUPPORTED")
    return t.events.select("event_id", F.when(F.col("value") < 5, "CLOSED").when(due, "OPEN").otherwise(late).alias("state"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor(l_quantity)::BIGINT AS q, l_extendedprice / floor(l_quantity) AS u FROM lineitem WHERE l_quantity >= 1),
e AS (SELECT *, unnest([q * 10, q + 1, q - 1]) AS other FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, count(*) FILTER (WHERE abs(l_extendedprice - other * u) > 0.01) AS n_would_fail, count(*) AS n_readings FROM e WHERE other > 0 GROUP BY ALL"""
)
def hold_suspects(t: Tables) -> DataFrame:
    """How many readings one slip away from a line's quantity would fail it."""
    q = F.floor("l_quantity").cast("long")
    rows = t.lineitem.where("l_quantity >= 1").withColumn("u", F.col("l_extendedprice") / q)
    read = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "u", F.explode(F.array(q * 10, q + 1, q - 1)).alias("other")).where("other > 0")
    fails = F.abs(F.col("l_extendedprice") - F.col("other") * F.col("u")) > 0.01
    return read.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count_if(fails).alias("n_would_fail"), F.count("*").alias("n_readings"))


@query(
    """WITH b AS (SELECT event_type AS series, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), p AS (SELECT series, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END AS x FROM events JOIN b ON series = event_type WHERE value IS NOT NULL), r AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY x) AS i, count(*) OVER (PARTITION BY series) AS n FROM p)
SELECT series, round(max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)), 9) AS discrepancy, max(n) AS n FROM r GROUP BY series"""
)
def star_discrepancy(t: Tables) -> DataFrame:
    """How far each kind's values are from even spread over their range: the exact one-dimensional star discrepancy.

    Values are counted first, so that a place in order is a cumulative count over distinct values.
    """
    bounds = t.events.groupBy(F.col("event_type").alias("series")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    counts = t.events.where("value is not null").groupBy(F.col("event_type").alias("series"), "value").agg(F.count("*").alias("c"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    points = counts.join(bounds, "series").groupBy("series", x.alias("x")).agg(F.sum("c").alias("c"))
    w = W.partitionBy("series")
    rows = points.withColumn("i", F.sum("c").over(w.orderBy("x").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("x"), F.col("x") - (F.col("i") - F.col("c")) / F.col("n"))
    return rows.groupBy("series").agg(F.round(F.max(gap), 9).alias("discrepancy"), F.max("n").alias("n"))


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'caught' WHEN event_id % 3 = 1 AND event_type <> 'view' THEN 'missed' ELSE 'false' END AS kind, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view') AND (event_id % 3 <> 2 OR event_type = 'view') AND NOT (event_type = 'view' AND event_id % 3 = 1) GROUP BY ALL"""
)
def truth_score(t: Tables) -> DataFrame:
    """Findings against the truth: caught, missed and false ones, by kind."""
    e = t.events.where("event_type in ('error', 'view')")
    truth = e.where("event_id % 3 = 0 or (event_id % 3 = 1 and event_type = 'error')").select("event_id", "event_type", F.lit(True).alias("true_"))
    found = e.where("event_id % 3 = 0 or (event_id % 3 = 2 and event_type = 'view')").select("event_id", "event_type", F.lit(True).alias("found"))
    both = truth.join(found, ["event_id", "event_type"], "full_outer")
    kind = F.when(F.col("true_").isNull(), "false").when(F.col("found").isNull(), "missed").otherwise("caught")
    return both.groupBy(kind.alias("kind"), "event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL"""
)
def daily_windows(t: Tables) -> DataFrame:
    """Tumbling days of events by kind, the batch form of the streamed windows."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    rows = t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'net' END, CASE WHEN o_orderkey % 3 = 0 THEN 'gross' END, CASE WHEN o_orderstatus = 'F' THEN 'standard' END) AS choice,
  CASE WHEN o_orderkey % 5 = 0 THEN 'STATED' WHEN o_orderkey % 3 = 0 THEN 'SUPPLIED' WHEN o_orderstatus = 'F' THEN 'DEFAULT' ELSE 'UNSTATED' END AS source_, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderstatus = 'F' THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS gate FROM orders"""
)
def choice_ledger(t: Tables) -> DataFrame:
    """Where each order's choice comes from; what depends on an unstated one stays open."""
    k = F.col("o_orderkey")
    stated, supplied, default = F.when(k % 5 == 0, "net"), F.when(k % 3 == 0, "gross"), F.when(F.col("o_orderstatus") == "F", "standard")
    choice = F.coalesce(stated, supplied, default)
    source = F.when(stated.isNotNull(), "STATED").when(supplied.isNotNull(), "SUPPLIED").when(default.isNotNull(), "DEFAULT").otherwise("UNSTATED")
    return t.orders.select("o_orderkey", choice.alias("choice"), source.alias("source_"), F.when(choice.isNull(), OPEN).otherwise(PASS).alias("gate"))
