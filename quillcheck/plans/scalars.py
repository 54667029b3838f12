"""Queries on numbers of any script, formats, days and small statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, numbers, stats
from ..functions.outcome import outcome
from ..functions.text import words_in_order
from .registry import Tables, query

_TOKENS = "regexp_extract_all(text, '[0-9][0-9.,]*[0-9]|[0-9]')"


@query(
    f"""WITH n AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, len(w)::INT AS n_numbers, len(list_filter(w, lambda x: regexp_matches(x, '{numbers.POINT}'))) > 0 AS p, len(list_filter(w, lambda x: regexp_matches(x, '{numbers.COMMA}'))) > 0 AS c FROM n)
SELECT doc_id, n_numbers, CASE WHEN p AND c THEN 'mixed' WHEN p THEN 'point' WHEN c THEN 'comma' END AS decimal_mark FROM m"""
)
def number_formats(t: Tables) -> DataFrame:
    """Each document's decimal mark, inferred from all numbers in it."""
    rows = t.documents.where("text is not null").select("doc_id", numbers.number_tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_numbers"), numbers.decimal_mark(F.col("w")).alias("decimal_mark"))


@query(
    """WITH w AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT::VARCHAR AS s FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(s)), lambda i: s[i] <> s[i + 1]), lambda i: s[1:i - 1] || s[i + 1] || s[i] || s[i + 2:]))), ' ') AS swaps FROM w"""
)
def swapped_readings(t: Tables) -> DataFrame:
    """What each order's whole total reads as when two neighbouring digits are swapped."""
    digits = F.floor("o_totalprice").cast("long").cast("string")
    return t.orders.select("o_orderkey", F.array_join(numbers.adjacent_swaps(digits), " ").alias("swaps"))


_SCRIPTS = ("ascii", "arabic", "devanagari", "full width", "mixed")


@query(
    """SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount, CASE o_orderkey % 5 WHEN 0 THEN 'ascii' WHEN 1 THEN 'arabic' WHEN 2 THEN 'devanagari' WHEN 3 THEN 'full width' ELSE 'mixed' END AS script,
  format('{:,}', floor(o_totalprice)::BIGINT) || right(o_totalprice::DECIMAL(18,2)::VARCHAR, 3) AS shown FROM orders WHERE o_totalprice >= 1000"""
)
def digits_read(t: Tables) -> DataFrame:
    """Totals read back from digits of four scripts, and of two at once; and as money is written."""
    value = F.col("o_totalprice").cast("decimal(18,2)")
    plain, k = value.cast("string"), F.col("o_orderkey") % 5
    shift = lambda x, c: F.translate(x, "0123456789", "".join(chr(c + d) for d in range(10)))
    written = F.when(k == 0, plain).otherwise(F.concat(F.lit("9"), shift(plain, 0x0E50)))
    for n, name in ((1, "arabic"), (2, "devanagari"), (3, "full width")):
        written = F.when(k == n, shift(plain, numbers.DIGIT_RUNS[name])).otherwise(written)
    rows = t.orders.where("o_totalprice >= 1000").select("o_orderkey", value.alias("v"), k.alias("k"), written.alias("w"))
    read = numbers.amount(numbers.fold_digits(F.when(F.col("k") == 4, F.substring("w", 2, 40)).otherwise(F.col("w"))))
    return rows.select("o_orderkey", read.cast("double").alias("amount"), numbers.digit_script("w").alias("script"), numbers.money_text("v").alias("shown"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(x, '(?i)%|\b(discount|disc|rebate|fee|surcharge|tax|vat|gst|credit|freight|shipping|deposit|less)\b') OR regexp_matches(x, '(^|\s)(-[$€£]?[0-9]|\([$€£]?[0-9][0-9.,]*\))')) AS n_adjusted FROM l GROUP BY doc_id"""
)
def adjusted_lines(t: Tables) -> DataFrame:
    """Lines of each document that name an adjustment, so that no arithmetic on them is judged."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(numbers.adjusted("x")).alias("n_adjusted"))


@query(
    """WITH e AS (SELECT event_id, ts, user_id % 5 AS k, CASE user_id % 5 WHEN 0 THEN 330 WHEN 1 THEN -480 WHEN 2 THEN 0 WHEN 3 THEN 845 END AS minutes FROM events),
d AS (SELECT *, CASE WHEN minutes <= 840 THEN (ts + to_minutes(minutes))::DATE END AS day FROM e)
SELECT event_id, CASE WHEN minutes <= 840 THEN minutes END::INT AS minutes, day, (date_trunc('week', day) + INTERVAL 7 DAY)::DATE AS week_end, (date_trunc('quarter', day) + INTERVAL 3 MONTH)::DATE AS quarter_end, last_day(day) AS month_end FROM d"""
)
def local_days(t: Tables) -> DataFrame:
    """Events by the day on the wall of their user (offsets written in several ways, one impossible), and what ends when."""
    k = F.col("user_id") % 5
    raw = F.when(k == 0, "+05:30").when(k == 1, "-0800").when(k == 2, "z").when(k == 3, "+14:05").otherwise("local")
    rows = t.events.select("event_id", "ts", calendar.offset_minutes(raw).alias("minutes"))
    rows = rows.select("event_id", "minutes", calendar.local_date("ts", F.col("minutes")).alias("day"))
    day = F.col("day")
    return rows.select("event_id", "minutes", "day", calendar.next_period(day, "week").alias("week_end"), calendar.next_period(day, "quarter").alias("quarter_end"), calendar.month_end(F.date_format("day", "yyyy-MM")).alias("month_end"))


@query(
    """WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS caught FROM lineitem GROUP BY 1), b AS (SELECT *, (n - caught) / n::DOUBLE AS p, 1.6448536269514722 AS z FROM s)
SELECT l_suppkey, round(1 - least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS caught_at_least, greatest(1, ceil(ln(0.05) / ln(1 - (l_suppkey % 50 + 1) / 1000.0) - 1e-9))::BIGINT AS zero_miss FROM b"""
)
def sample_bounds(t: Tables) -> DataFrame:
    """Per supplier the least share of lines not returned, at 95 %, and how many clean cases would clear a bar."""
    rows = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("caught"))
    bar = (F.col("l_suppkey") % 50 + 1) / 1000.0
    return rows.select("l_suppkey", F.round(stats.caught_rate(F.col("caught"), F.col("n")), 9).alias("caught_at_least"), stats.zero_miss_size(bar).alias("zero_miss"))


@query(
    """WITH a AS (SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2)) AS actual FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN actual IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(round(actual) - actual) <= 0.001 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM orders LEFT JOIN a ON l_orderkey = o_orderkey"""
)
def quantity_match(t: Tables) -> DataFrame:
    """Whether the quantity claimed for an order (in whole pieces) is what its lines come to, within a thousandth."""
    actual = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("actual"))
    rows = t.orders.select("o_orderkey").join(actual, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", outcome(F.abs(F.round("actual") - F.col("actual")) <= 0.001).alias("outcome"))


@query(
    """SELECT event_id, CASE WHEN user_id IS NULL OR event_type IS NULL OR value IS NULL THEN 'INSUFFICIENT_DATA' WHEN first = event_id THEN 'PASS' ELSE 'FAIL' END AS outcome, CASE WHEN first <> event_id THEN first END AS prior
FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type, round(value) ORDER BY ts, event_id) AS first FROM events)"""
)
def no_prior_claim(t: Tables) -> DataFrame:
    """Whether an event is the first claim of its user, kind and rounded value; a later one names the first."""
    key = F.struct("user_id", "event_type", F.round("value").alias("value"))
    rows = t.events.select("event_id", F.struct("ts", "event_id").alias("at"), F.when(F.expr("user_id is not null and event_type is not null and value is not null"), key).alias("key"))
    firsts = rows.where("key is not null").groupBy(F.col("key").alias("k")).agg(F.min("at")["event_id"].alias("first"))
    rows = rows.join(firsts, F.col("key") == F.col("k"), "left")
    return rows.select("event_id", outcome(F.col("first") == F.col("event_id")).alias("outcome"), F.when(F.col("first") != F.col("event_id"), F.col("first")).alias("prior"))


@query(
    """WITH f AS (SELECT p_brand, string_split(arg_min(p_name, p_partkey), ' ') AS o FROM part GROUP BY p_brand),
s AS (SELECT DISTINCT p_brand, [o[j] FOR j IN range(1, len(o) + 1) IF (k >> (j - 1)) % 2 = 1] AS sub FROM f, unnest(range(0, 1 << len(o))) r(k)),
w AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part), x AS (SELECT p_partkey, p_brand, [w[j] FOR j IN range(1, len(w) + 1) IF (k >> (j - 1)) % 2 = 1] AS sub FROM w, unnest(range(0, 1 << len(w))) r(k))
SELECT p_partkey, max(len(x.sub))::INT AS n_shared FROM x JOIN s ON s.p_brand = x.p_brand AND s.sub = x.sub GROUP BY p_partkey"""
)
def names_in_order(t: Tables) -> DataFrame:
    """How many words each part's name shares, in order, with the first part's of its brand; the SQL tries all choices of words."""
    firsts = t.part.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("other"))
    shared = words_in_order(F.split("p_name", " "), F.split("other", " "))
    return t.part.join(firsts, "p_brand").select("p_partkey", shared.alias("n_shared"))
