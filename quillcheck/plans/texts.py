"""Queries on values as written: numbers, identifiers, names, tables, JSON and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.outcome import jaccard, outcome
from ..sources import population
from .registry import Tables, query


@query(
    """WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_totalprice::DECIMAL(18,2) AS v FROM orders)
SELECT o_orderkey, CASE k WHEN 4 THEN NULL WHEN 2 THEN -v ELSE v END::DOUBLE AS amount FROM r"""
)
def amounts_read(t: Tables) -> DataFrame:
    """Amounts read back from five ways of writing them: plain, dollars, in brackets, with a decimal comma, in words."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    english = F.format_number(v, 2)
    german = F.translate(english, ",.", ".,")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, v.cast("string")).when(k == 1, F.concat(F.lit("$ "), english)).when(k == 2, F.concat(F.lit("("), english, F.lit(")"))).when(k == 3, F.concat(german, F.lit(" EUR"))).otherwise("forty-two")
    return t.orders.select("o_orderkey", numbers.amount(raw).cast("double").alias("amount"))


@query(
    """WITH r AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN v WHEN 1 THEN -v WHEN 2 THEN -v END::DOUBLE AS declared, CASE WHEN k = 3 THEN 'INSUFFICIENT_DATA' WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END AS positive FROM r"""
)
def declared_amounts(t: Tables) -> DataFrame:
    """Amounts by a declared format (point for groups, decimal comma): what is written otherwise is not read."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    german = F.translate(F.format_number(v, 2), ",.", ".,")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, german).when(k == 1, F.concat(german, F.lit("-"))).when(k == 2, F.concat(F.lit("("), german, F.lit(")"))).otherwise(F.concat(v.cast("string"), F.lit("1")))
    read = numbers.decimal_text(raw, ",", ".")
    return t.orders.select("o_orderkey", read.cast("double").alias("declared"), outcome(read > 0).alias("positive"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '(^|[^0-9.,])[0-9]{3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.,]|$)'))::INT AS n_addresses, regexp_matches(text, '(^|[^0-9.,])555-[0-9]{4}([^0-9]|$)') AS has_number FROM documents"""
)
def values_in_text(t: Tables) -> DataFrame:
    """Numbers that stand by themselves, not inside longer ones."""
    n = F.regexp_count("text", F.lit(r"(^|[^0-9.,])[0-9]{3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.,]|$)"))
    return t.documents.select("doc_id", n.alias("n_addresses"), F.col("text").rlike(r"(^|[^0-9.,])555-[0-9]{4}([^0-9]|$)").alias("has_number"))


@query(
    """WITH c AS (SELECT o_orderkey, (floor(o_totalprice) * 1)::BIGINT AS w FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1), v AS (SELECT o.o_orderkey, c.w, o.o_totalprice::DECIMAL(28,2) AS d FROM orders o JOIN c USING (o_orderkey))
SELECT o_orderkey, array_to_string(CASE WHEN w IS NOT NULL THEN [w::VARCHAR, w || '.00', format('{:,}', w), format('{:,}', w) || '.00'] ELSE [d::VARCHAR, format('{:,}', floor(d)::BIGINT) || right(d::VARCHAR, 3)] END, ' | ') AS forms FROM v WHERE d >= 1000 AND (w IS NOT NULL OR right(d::VARCHAR, 3) <> '.00')"""
)
def surface_forms(t: Tables) -> DataFrame:
    """How an amount may be written."""
    v = F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice")).otherwise(F.col("o_totalprice")).cast("decimal(28,2)")
    cents = F.col("o_totalprice").cast("decimal(28,2)")
    rows = t.orders.where((cents >= 1000) & ((F.col("o_orderkey") % 2 == 0) | (cents % 1 != 0)))
    return rows.select("o_orderkey", F.array_join(numbers.surface_forms(v), " | ").alias("forms"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9_]+'), lambda w: len(w) > 2))"


@query(
    f"""WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, {_WORDS.format("p_name")} AS w FROM part), f AS (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY ALL)
SELECT a.p_partkey, f.first AS against, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE ELSE 0 END AS jaccard,
  CASE WHEN least(len(a.w), len(b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE ELSE 0 END AS overlap
FROM p a JOIN f ON f.p_brand = a.p_brand AND f.p_type = a.p_type JOIN p b ON b.p_partkey = f.first"""
)
def name_similarity(t: Tables) -> DataFrame:
    """Each part's name against that of the first part of its brand and type: shared words."""
    firsts = t.part.groupBy("p_brand", "p_type").agg(F.min(F.struct("p_partkey", "p_name")).alias("f"))
    rows = t.part.join(firsts, ["p_brand", "p_type"])
    other = F.col("f.p_name")
    return rows.select("p_partkey", F.col("f.p_partkey").alias("against"), jaccard("p_name", other).cast("double").alias("jaccard"), text.overlap("p_name", other).cast("double").alias("overlap"))


@query(
    """WITH n AS (SELECT s_suppkey, s_nationkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS name FROM supplier), c AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, damerau_levenshtein(a.name, b.name) AS d, greatest(length(a.name), length(b.name)) AS l FROM n a JOIN n b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT a, b, d::INT AS edits FROM c WHERE d <= CASE WHEN l < 6 THEN 0 WHEN l < 16 THEN 1 WHEN l < 32 THEN 2 ELSE 3 END"""
)
def near_names(t: Tables) -> DataFrame:
    """Suppliers of a nation whose names are within the edits that the longer one's length allows; two neighbours swapped
    are one edit.

    Names within k edits become equal by deleting at most k characters from each, a swap included, so distinct names of a
    nation meet on hashes of what such deletions leave. Names that share such a rest are at most 2k edits apart, so a part that all
    names have, as a common first word, makes no pairs. A name has as many rests as ways to delete: 172 at 18 characters
    (two edits), 5,489 at 32 (three).
    """
    rows = t.supplier.select("s_suppkey", "s_nationkey", text.vendor_name("s_name").alias("name")).where("name is not null and s_nationkey is not null")
    names = rows.select("s_nationkey", "name").distinct()
    rests = names.select("s_nationkey", "name", F.explode(text.deletions("name", text.allowed_edits(F.length("name")))).alias("rest"))
    tasks = int(t.supplier.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make much work here, so small partitions are not merged
    rests = rests.repartition(tasks, "s_nationkey", "rest")
    left, right = rests.withColumnRenamed("name", "x"), rests.withColumnRenamed("name", "y")
    pairs = left.join(right, ["s_nationkey", "rest"]).where("x < y").select("s_nationkey", "x", "y").repartition(tasks, "x", "y").distinct()
    most = text.allowed_edits(F.greatest(F.length("x"), F.length("y")))
    near = pairs.where(F.levenshtein("x", "y", 6) >= 0).withColumn("edits", text.edits("x", "y")).where(F.col("edits") <= most)
    a, b = rows.select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("name").alias("x")), rows.select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("name").alias("y"))
    unlike = near.join(a, ["s_nationkey", "x"]).join(b, ["s_nationkey", "y"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "edits")
    alike = a.join(b.withColumnRenamed("y", "x"), ["s_nationkey", "x"]).where("a < b").select("a", "b", F.lit(0).alias("edits"))
    return unlike.unionByName(alike)


@query(
    """SELECT c_custkey, 'CUSTOMER' || lpad(c_custkey::VARCHAR, 9, '0') AS folded_key, 'CUSTOMER|' || c_custkey AS tight, 'CUSTOMER' || lpad(c_custkey::VARCHAR, 9, '0') AS document_number, 'customer ' || lpad(c_custkey::VARCHAR, 9, '0') AS vendor FROM customer"""
)
def identifier_forms(t: Tables) -> DataFrame:
    """Customer names in the forms that identifiers are compared in."""
    n = "c_name"
    return t.customer.select(
        "c_custkey", text.identifier_key(n).alias("folded_key"), text.tight_id(n).alias("tight"), text.document_number(n).alias("document_number"), text.vendor_name(n).alias("vendor")
    )


@query(
    """SELECT n_nationkey AS doc, 'Orders in thousands' AS title, 1000 AS scale, label, k AS "column", cell, v * 1000.0 AS value FROM (
  SELECT n_nationkey, n_name AS label, unnest(['keys', 'negative', 'words']) AS k, unnest([n_nationkey::VARCHAR, '(1,00' || (n_regionkey) || ')', 'n/a']) AS cell,
    unnest([n_nationkey::DOUBLE, -(1000 + n_regionkey)::DOUBLE, NULL]) AS v FROM nation)"""
)
def table_cells(t: Tables) -> DataFrame:
    """Cells of the plain-text tables that nations are written as."""
    lines = F.array(
        F.lit("TABLE: Orders in thousands"), F.lit("COLUMNS: keys | negative | words"),
        F.concat(F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" | (1,00"), F.col("n_regionkey").cast("string"), F.lit(") | n/a")),
    )
    rows = t.nation.select(F.col("n_nationkey").alias("doc"), F.posexplode(lines).alias("n", "line"))
    return population.text_tables(rows, "doc", "n", "line")


@query("SELECT event_id, (props->>'$.k')::INT AS k, sha256('{\"k\":' || (props->>'$.k') || '}') AS hash FROM events")
def canonical_props(t: Tables) -> DataFrame:
    """Properties as canonical JSON, hashed, and a value read from them."""
    rows = population.canonical_json(t.events.select("event_id", "props"), "props", ["event_id"])
    return rows.select("event_id", F.get_json_object("canonical", "$.k").cast("int").alias("k"), "hash")


@query(
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="[^"]*"'))::INT AS n_links, len(regexp_extract_all(html, '<p>'))::INT AS n_paragraphs, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"""
)
def page_facts(t: Tables) -> DataFrame:
    """What can be read off a page's markup by pattern."""
    count = lambda p: F.regexp_count("html", F.lit(p))
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count('<a href="[^"]*"').alias("n_links"), count("<p>").alias("n_paragraphs"),
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"),
    )


@query(
    """WITH l AS (SELECT l_orderkey AS o, l_extendedprice::DECIMAL(18,2) AS a FROM lineitem) SELECT o, count(*) AS n, sum(a)::DOUBLE AS lines_net, CASE WHEN o % 100 = 0 THEN 'PASS' ELSE 'FAIL' END AS foots FROM l GROUP BY o"""
)
def xml_invoices(t: Tables) -> DataFrame:
    """Invoices written as XML and read back: their lines, and whether the stated net is what they come to."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_extendedprice").cast("decimal(18,2)").alias("a"))
    body = F.concat_ws("", F.collect_list(F.concat(F.lit("<Line><Amount>"), F.col("a").cast("string"), F.lit("</Amount></Line>"))))
    stated = (F.sum("a") + F.when(F.col("o") % 100 == 0, 0).otherwise(1)).cast("decimal(18,2)").cast("string")
    docs = lines.groupBy("o").agg(F.concat(F.lit("<Invoice><Net>"), stated, F.lit("</Net>"), body, F.lit("</Invoice>")).alias("xml"))
    read = docs.select("o", F.from_xml("xml", "Net decimal(18,2), Line array<struct<Amount: decimal(18,2)>>").alias("x"))
    net = F.aggregate("x.Line", F.lit(0).cast("decimal(18,2)"), lambda a, l: (a + l["Amount"]).cast("decimal(18,2)"))
    return read.select("o", F.size("x.Line").cast("long").alias("n"), net.cast("double").alias("lines_net"), outcome(F.abs(net - F.col("x.Net")) <= 0.01).alias("foots"))


@query(
    """SELECT doc_id, upper(trim(regexp_extract(text, '(https?://)?([a-z0-9.]+)@([a-z0-9.-]+)', 3))) AS domain FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.-]+')"""
)
def sender_domains(t: Tables) -> DataFrame:
    """The first sender domain that a text names."""
    found = F.upper(F.trim(F.regexp_extract("text", "(https?://)?([a-z0-9.]+)@([a-z0-9.-]+)", 3)))
    return t.documents.where(F.col("text").rlike("[a-z0-9.]+@[a-z0-9.-]+")).select("doc_id", found.alias("domain"))
