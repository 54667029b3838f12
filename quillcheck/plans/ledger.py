"""Queries on the event log: chains, periods, samples, calibration and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.outcome import outcome
from ..operators import ledger, usage
from .registry import Tables, query

_SEQ = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events"


def _chains(t: Tables) -> DataFrame:
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("value").cast("decimal(18,2)").cast("string"))
    return ledger.build_chains(t.events, "user_id", ["ts", "event_id"], payload)


@query(
    f"""WITH RECURSIVE s AS ({_SEQ}), p AS (SELECT user_id, seq, event_id, sha256(event_id || '|' || event_type || '|' || value::DECIMAL(18,2)) AS h FROM s),
c AS (SELECT user_id, seq, event_id, sha256('0:' || repeat('0', 64) || ':' || h) AS e, repeat('0', 64) AS prev FROM p WHERE seq = 0
  UNION ALL SELECT p.user_id, p.seq, p.event_id, sha256(p.seq || ':' || c.e || ':' || p.h), c.e FROM c JOIN p ON p.user_id = c.user_id AND p.seq = c.seq + 1)
SELECT user_id, seq::INT AS seq, event_id, prev AS prev_hash, e AS entry_hash FROM c"""
)
def chain_entries(t: Tables) -> DataFrame:
    """Each user's events as a hash chain."""
    return _chains(t).select("user_id", "seq", "event_id", "prev_hash", "entry_hash")


@query(
    f"""WITH s AS ({_SEQ}), n AS (SELECT user_id, count(*) AS n, max(seq) AS last FROM s GROUP BY user_id)
SELECT user_id, n - CASE WHEN user_id % 10 = 3 AND n > 5 THEN 1 ELSE 0 END AS n,
  CASE WHEN n > 5 THEN CASE user_id % 10 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN CASE WHEN n > 6 THEN 6 END WHEN 4 THEN 5 END END::INT AS first_break,
  CASE WHEN n > 5 THEN CASE user_id % 10 WHEN 1 THEN 'payload' WHEN 2 THEN 'entry_hash' WHEN 3 THEN CASE WHEN n > 6 THEN 'seq' END WHEN 4 THEN 'prev_hash' END END AS reason FROM n"""
)
def chain_breaks(t: Tables) -> DataFrame:
    """Where chains break that were tampered with at entry 5: a payload changed, a hash, an entry lost, a link."""
    kind, fifth = F.col("user_id") % 10, F.col("seq") == 5
    chains = _chains(t).where(~((kind == 3) & fifth))
    chains = chains.withColumns(
        {
            "value": F.when((kind == 1) & fifth, F.col("value") + 1).otherwise(F.col("value")),
            "entry_hash": F.when((kind == 2) & fifth, F.sha2(F.lit("x"), 256)).otherwise(F.col("entry_hash")),
            "prev_hash": F.when((kind == 4) & fifth, F.sha2(F.lit("y"), 256)).otherwise(F.col("prev_hash")),
        }
    )
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("value").cast("decimal(18,2)").cast("string"))
    return ledger.verify_chains(chains, "user_id", payload).drop("head")


@query(
    f"""WITH s AS ({_SEQ}), n AS (SELECT user_id, count(*) AS n, user_id % 10 AS kind FROM s GROUP BY user_id),
c AS (SELECT DISTINCT user_id, kind, n, unnest([4, 8, n, 0]) AS length FROM n WHERE n > 8),
v AS (SELECT *, CASE WHEN length < 1 THEN 'refused' WHEN kind = 3 AND length > n - 2 THEN 'truncated' WHEN kind = 1 AND length > 5 THEN 'broken' WHEN kind = 5 AND length > 5 THEN 'rewritten' WHEN kind = 6 AND length = 8 THEN 'rewritten' ELSE 'held' END AS status FROM c)
SELECT user_id, length::BIGINT AS length, status, CASE WHEN status IN ('broken', 'rewritten') THEN 4 END::BIGINT AS since, CASE WHEN status IN ('broken', 'rewritten') THEN length - 1 END::BIGINT AS upto FROM v"""
)
def chain_checkpoints(t: Tables) -> DataFrame:
    """Checkpoints of each user's chain at entries 4, 8 and the last, against chains that lost their end, had a payload
    changed, or were rewritten from entry 5 on; and some forged checkpoints."""
    kind, n = F.col("user_id") % 10, F.col("n")
    chains = _chains(t)
    lengths = chains.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 8")
    points = lengths.select("user_id", F.explode(F.array_distinct(F.array(F.lit(4).cast("bigint"), F.lit(8).cast("bigint"), n, F.lit(0).cast("bigint")))).alias("length"))
    points = points.join(chains.select("user_id", (F.col("seq") + 1).alias("length"), F.col("entry_hash").alias("head")), ["user_id", "length"], "left")
    points = points.withColumn("head", F.when((kind == 6) & (F.col("length") == 8), F.sha2("head", 256)).otherwise(F.col("head")))
    changed = F.when((kind == 5) & (F.col("seq") == 5), F.col("value") + 1).otherwise(F.col("value"))
    events = chains.join(lengths, "user_id").where((kind != 3) | (F.col("seq") < n - 2)).withColumn("value", changed).select("user_id", "event_id", "event_type", "value", "ts")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("value").cast("decimal(18,2)").cast("string"))
    book = ledger.build_chains(events, "user_id", ["ts", "event_id"], payload)
    book = book.withColumn("value", F.when((kind == 1) & (F.col("seq") == 5), F.col("value") + 1).otherwise(F.col("value")))
    return ledger.against_checkpoints(book, points, "user_id", payload)


_CLOCK = "CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END"


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_CLOCK} AS tick FROM events), c AS (SELECT *, date_trunc('day', max(tick) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS period FROM e),
g AS (SELECT user_id, period, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq FROM c GROUP BY ALL)
SELECT user_id, period::TIMESTAMP AS period, n, first_seq, last_seq, lead(first_seq) OVER (PARTITION BY user_id ORDER BY period) AS closed_by FROM g"""
)
def chain_periods(t: Tables) -> DataFrame:
    """Each user's calendar days by the largest time so far, and what closed them; some clocks step back."""
    at = F.when(F.col("event_id") % 17 == 0, F.expr("ts - INTERVAL 3 DAY")).otherwise(F.col("ts"))
    events = t.events.select("event_id", "user_id", at.cast("timestamp").alias("at"))
    return ledger.close_periods(ledger.chain_periods(events, ["user_id"], "event_id", "at", "day"), ["user_id"], "event_id")


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, value, date_trunc('day', max({_CLOCK}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS period FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY period, user_id ORDER BY event_id DESC) AS n FROM e) SELECT period::TIMESTAMP AS period, event_type AS stratum, count(*) AS n FROM k WHERE n = 1 GROUP BY ALL"""
)
def period_frame(t: Tables) -> DataFrame:
    """The frame that a period's sample is drawn from: the last event of each user decides the stratum."""
    at = F.when(F.col("event_id") % 17 == 0, F.expr("ts - INTERVAL 3 DAY")).otherwise(F.col("ts"))
    events = t.events.select("event_id", "user_id", "event_type", at.cast("timestamp").alias("at"))
    rows = ledger.chain_periods(events, ["user_id"], "event_id", "at", "day")
    last = ledger.latest(rows, ["period", "user_id"], F.col("event_id"))
    return last.groupBy("period", F.col("event_type").alias("stratum")).agg(F.count("*").alias("n"))


@query(
    """WITH h AS (SELECT event_id, event_type, sha256('s1:' || event_type || ':' || event_id) AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k, event_id) AS draw_rank, count(*) OVER (PARTITION BY event_type) AS n FROM h)
SELECT event_id, event_type, draw_rank FROM r WHERE draw_rank <= least(n, ceil(0.05 * n - 1e-9))"""
)
def stratified_draw(t: Tables) -> DataFrame:
    """Five percent of each kind of event, the same on every run."""
    return ledger.draw(t.events.select("event_id", "event_type"), ["event_type"], "event_id", "s1", 0.05)


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_force FROM events"""
)
def as_of_grant(t: Tables) -> DataFrame:
    """The grant (a purchase) in force at each event."""
    state = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return ledger.in_force(t.events.select("event_id", "user_id", "event_type"), ["user_id"], "event_id", state).drop("event_type")


@query("SELECT user_id, max(event_id) AS grant_id, max_by(value, event_id) AS granted FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def grants_now(t: Tables) -> DataFrame:
    """The grant in force now."""
    rows = t.events.where("event_type = 'purchase'").groupBy("user_id")
    return rows.agg(F.max("event_id").alias("grant_id"), F.max_by("value", "event_id").alias("granted"))


@query(
    """WITH r AS (SELECT source AS workflow, doc_id, quality, toxic, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id DESC) AS n FROM labels JOIN documents USING (doc_id))
SELECT workflow, count(*) FILTER (WHERE n = 1) AS counted, count(*) FILTER (WHERE n > 1) AS excluded, count(*) FILTER (WHERE n = 1 AND quality = 1) AS passed,
  count(*) FILTER (WHERE n = 1 AND quality = 1 AND toxic = 1) AS overturned, coalesce(count(*) FILTER (WHERE n = 1 AND quality = 1 AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (WHERE n = 1 AND quality = 1), 0), 0)::DOUBLE AS overturn_rate
FROM r GROUP BY workflow"""
)
def workflow_calibration(t: Tables) -> DataFrame:
    """How often later review overturned a pass, by workflow; of repeated texts only the last record counts."""
    rows = t.labels.join(t.documents.select("doc_id", F.col("source").alias("workflow"), F.md5("text").alias("h")), "doc_id")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("workflow", "h").orderBy(F.desc("doc_id"))))
    last, passed = F.col("n") == 1, (F.col("n") == 1) & (F.col("quality") == 1)
    out = rows.groupBy("workflow").agg(
        F.count_if(last).alias("counted"), F.count_if(~last).alias("excluded"), F.count_if(passed).alias("passed"), F.count_if(passed & (F.col("toxic") == 1)).alias("overturned")
    )
    return out.withColumn("overturn_rate", F.coalesce(F.try_divide("overturned", "passed"), F.lit(0.0)))


@query(
    """WITH q AS (SELECT event_type AS workflow, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events WHERE value > 40) SELECT workflow, event_id, place::INT AS place FROM q WHERE place <= 10"""
)
def review_queue(t: Tables) -> DataFrame:
    """The ten oldest items due for review in each workflow."""
    due = t.events.where("value > 40").select(F.col("event_type").alias("workflow"), "event_id", "ts")
    place = F.row_number().over(W.partitionBy("workflow").orderBy("ts", "event_id"))
    return due.withColumn("place", place).where("place <= 10").select("workflow", "event_id", "place")


@query(
    """WITH b AS (SELECT user_id, min(event_id) AS row FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) = 1)
SELECT event_id, e.user_id, b.row FROM events e LEFT JOIN b ON b.user_id = e.user_id WHERE event_type = 'view'"""
)
def usage_by_id(t: Tables) -> DataFrame:
    """Views with the click of the same user, where there is exactly one."""
    replies = t.events.where("event_type = 'view'").select("event_id", "user_id")
    billed = t.events.where("event_type = 'click'").select(F.col("user_id").alias("billed_user"), "event_id")
    return usage.by_id(replies, billed, "user_id", "billed_user", "event_id")


@query(
    """WITH r AS (SELECT event_id AS reply, user_id, epoch(ts) AS a FROM events WHERE event_type = 'view'), b AS (SELECT event_id AS row, user_id, epoch(ts) AS z FROM events WHERE event_type = 'click')
SELECT reply, b.row, r.user_id, count(*) OVER (PARTITION BY reply) AS n_rows, count(*) OVER (PARTITION BY b.row) AS n_replies FROM r JOIN b ON r.user_id = b.user_id AND abs(a - z) <= 7200"""
)
def usage_by_time(t: Tables) -> DataFrame:
    """Views and clicks of a user within two hours of one another, and how many partners each has."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s")
    replies = t.events.where("event_type = 'view'").select(F.col("event_id").alias("reply"), "user_id", seconds)
    billed = t.events.where("event_type = 'click'").select(F.col("event_id").alias("row"), "user_id", seconds)
    found = usage.by_time_and_tokens(replies, billed, ["user_id"], "s", 7200)
    return found.select("reply", "row", "user_id", "n_rows", "n_replies")


@query(
    """WITH r AS (SELECT date_trunc('hour', ts) AS hour, event_type AS model, sum(floor(value)::BIGINT) AS replied, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL),
b AS (SELECT date_trunc('hour', ts) AS hour, event_type AS model, (sum(floor(value)::BIGINT) - CASE WHEN count(*) % 4 = 3 THEN 10 ELSE 0 END)::BIGINT AS billed FROM events WHERE event_id % 5 <> 0 OR event_id % 10 = 0 GROUP BY ALL)
SELECT coalesce(r.hour, b.hour)::TIMESTAMP AS hour, coalesce(r.model, b.model) AS model, coalesce(n, 0) AS n_replies, replied::BIGINT AS replied, billed,
  CASE WHEN billed IS NULL THEN 'NOT_BILLED' WHEN replied IS NULL THEN 'NO_REPLIES' WHEN billed < replied THEN 'SHORT' WHEN billed = replied THEN 'EXACT' ELSE 'CONTAINED' END AS match
FROM r FULL OUTER JOIN b ON r.hour = b.hour AND r.model = b.model"""
)
def usage_by_bucket(t: Tables) -> DataFrame:
    """Hourly sums of replies against hourly bills."""
    hour, tokens = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), F.floor("value").alias("tokens")
    rows = t.events.select("event_id", hour, F.col("event_type").alias("model"), tokens)
    billed = rows.where("event_id % 5 <> 0 or event_id % 10 = 0").groupBy("hour", "model").agg(
        (F.sum("tokens") - F.when(F.count("*") % 4 == 3, 10).otherwise(0)).alias("billed")
    )
    return usage.by_bucket(rows.where("event_id % 5 <> 0"), billed, ["hour", "model"], "tokens")


_WIDTHS = "CASE user_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 86400 END"


@query(
    f"""WITH e AS (SELECT event_id, user_id % 3 AS team, event_type AS model, epoch(date_trunc('second', ts))::BIGINT AS tick, floor(abs(value))::BIGINT AS tokens, {_WIDTHS} AS w FROM events),
r AS (SELECT * FROM e WHERE event_id % 5 <> 0), b AS (SELECT team, model, tick - tick % w AS start, tick - tick % w + w AS "end", (sum(tokens) - CASE WHEN count(*) % 4 = 3 THEN 10 ELSE 0 END)::BIGINT AS billed FROM e WHERE event_id % 7 <> 0 OR event_id % 10 = 0 GROUP BY ALL),
m AS (SELECT b.team, b.model, b.start, b."end", b.billed, count(r.tick) AS n, sum(r.tokens)::BIGINT AS replied FROM b LEFT JOIN r ON r.team = b.team AND r.model = b.model AND r.tick >= b.start AND r.tick < b."end" GROUP BY ALL)
SELECT team, model, start, "end", n AS n_replies, replied, billed, CASE WHEN n = 0 THEN 'NO_REPLIES' WHEN billed < replied THEN 'SHORT' WHEN billed = replied THEN 'EXACT' ELSE 'CONTAINED' END AS match, CASE "end" - start WHEN 60 THEN 'minute' WHEN 3600 THEN 'hour' ELSE 'day' END AS confidence FROM m
UNION ALL SELECT team, model, tick - tick % 60, tick - tick % 60 + 60, count(*), sum(tokens)::BIGINT, NULL, 'NOT_BILLED', NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE r.team = b.team AND r.model = b.model AND r.tick >= b.start AND r.tick < b."end") GROUP BY ALL"""
)
def mixed_buckets(t: Tables) -> DataFrame:
    """Replies against bills by the minute, hour or day, whichever each team's provider writes."""
    width = F.when(F.col("user_id") % 3 == 0, 60).when(F.col("user_id") % 3 == 1, 3600).otherwise(86400)
    rows = t.events.select(
        "event_id", (F.col("user_id") % 3).alias("team"), F.col("event_type").alias("model"), F.unix_timestamp("ts").alias("at"), F.floor(F.abs("value")).alias("tokens"), width.cast("bigint").alias("w")
    )
    billed = rows.where("event_id % 7 <> 0 or event_id % 10 = 0").groupBy("team", "model", (F.col("at") - F.col("at") % F.col("w")).alias("start"), "w")
    billed = billed.agg((F.sum("tokens") - F.when(F.count("*") % 4 == 3, 10).otherwise(0)).alias("billed")).withColumn("end", F.col("start") + F.col("w"))
    return usage.by_mixed_buckets(rows.where("event_id % 5 <> 0"), billed, ["team", "model"])


@query(
    """WITH m AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS was, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT * FROM m WHERE was <> event_type)
SELECT event_id, user_id, was AS from_model, event_type AS to_model, (nth - coalesce(lag(nth) OVER (PARTITION BY user_id ORDER BY nth), 1))::INT AS lasted FROM c"""
)
def model_switches(t: Tables) -> DataFrame:
    """Where consecutive events of a user change kind, and how long the last kind lasted."""
    found = usage.switches(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.select("event_id", "user_id", "from_model", F.col("event_type").alias("to_model"), "lasted")


@query(
    """WITH n AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
SELECT conv_id, turn, coalesce(after, 'end') AS before_ FROM n WHERE role = 'assistant' AND coalesce(after, 'user') = 'user'"""
)
def turn_ends(t: Tables) -> DataFrame:
    """The assistant's last word of each turn: what comes before the user speaks again, or last."""
    rows = t.conversations.withColumn("after", F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")))
    ends = rows.where("role = 'assistant' and coalesce(after, 'user') = 'user'")
    return ends.select("conv_id", "turn", F.coalesce("after", F.lit("end")).alias("before_"))


@query(
    """WITH s AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS evidence_at, max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS spoiled_at
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, evidence_at, spoiled_at, CASE WHEN evidence_at IS NULL THEN 'NO_EVIDENCE' WHEN spoiled_at > evidence_at THEN 'STALE' ELSE 'SUPPORTED' END AS support FROM s WHERE event_type = 'purchase'"""
)
def claims_supported(t: Tables) -> DataFrame:
    """Whether each purchase follows a view that no later error has spoiled."""
    kind = F.col("event_type")
    rows = t.events.select("event_id", "user_id", "event_type")
    return usage.evidence_before(rows, ["user_id"], "event_id", kind == "purchase", kind == "view", kind == "error").drop("event_type")


@query(
    """WITH c AS (SELECT user_id, event_type AS choice, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), m AS (SELECT user_id, max_by(choice, n * 1000000000 - first) AS modal, max(n) AS top, sum(n)::BIGINT AS n, (max(n) - min(n))::BIGINT AS swing FROM c GROUP BY user_id)
SELECT user_id, modal, n, top / n::DOUBLE AS stability, 1 - top / n::DOUBLE AS flip_rate, swing FROM m"""
)
def flip_statistics(t: Tables) -> DataFrame:
    """Each user's most frequent choice (ties: the one made first), how stable it is, and the swing between choices."""
    counts = t.events.groupBy("user_id", F.col("event_type").alias("choice")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    out = counts.groupBy("user_id").agg(
        F.max_by("choice", F.struct("n", (-F.col("first")).alias("f"))).alias("modal"), F.max("n").alias("top"), F.sum("n").alias("n"), (F.max("n") - F.min("n")).alias("swing")
    )
    share = F.col("top") / F.col("n")
    return out.select("user_id", "modal", "n", share.alias("stability"), (1 - share).alias("flip_rate"), "swing")


@query(
    """SELECT o_orderkey, (SELECT max(d)::DATE FROM (SELECT d FROM (SELECT o_orderdate::DATE + i::INT AS d FROM range(1, 20) r(i)) WHERE isodow(d) < 6 ORDER BY d LIMIT 5)) AS due, 
  CASE WHEN ships IS NULL THEN 'INSUFFICIENT_DATA' WHEN ships <= (SELECT max(d)::DATE FROM (SELECT d FROM (SELECT o_orderdate::DATE + i::INT AS d FROM range(1, 20) r(i)) WHERE isodow(d) < 6 ORDER BY d LIMIT 5)) THEN 'PASS' ELSE 'FAIL' END AS outcome
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate)::DATE AS ships FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def working_day_deadline(t: Tables) -> DataFrame:
    """The fifth working day after each order, and whether anything shipped by then."""
    day = F.col("o_orderdate").cast("date")
    days = F.filter(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.date_add(day, i)), lambda d: F.weekday(d) < 5)
    due = F.element_at(days, 5)
    ships = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("ships"))
    rows = t.orders.select("o_orderkey", due.alias("due")).join(ships, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", "due", outcome(F.col("ships") <= F.col("due")).alias("outcome"))
