"""Queries that read inside JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths
from .registry import Tables, query

# One document an order: its total under a key as each priority's system writes it.
_KEYS = {"1-URGENT": "total", "2-HIGH": "to​tal", "3-MEDIUM": "ｔｏｔａｌ", "4-NOT SPECIFIED": "Total", "5-LOW": "total "}
_KEY_SQL = " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in _KEYS.items())


@query(
    f"""WITH d AS (SELECT o_orderkey, '{{"bill":{{"' || CASE o_orderpriority {_KEY_SQL} END || '":"' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END || '"}}}}' AS doc FROM orders),
k AS (SELECT o_orderkey, json_keys(doc, '$.bill')[1] AS k, json_extract_string(doc, '$.bill.*')[1] AS v FROM d)
SELECT o_orderkey, CASE WHEN k <> 'total' AND v <> '' AND regexp_replace(translate(k, 'ｔｏａｌ', 'toal'), '[\\x{{200b}}\\x{{a0}} ]', '', 'g') = 'total' THEN 'bill.' || k END AS written FROM k"""
)
def near_miss_keys(t: Tables) -> DataFrame:
    """Where a document writes bill.total with blanks, invisible or full-width characters, so that it is refused, not absent."""
    key = F.create_map(*[F.lit(x) for pair in _KEYS.items() for x in pair])[F.col("o_orderpriority")]
    value = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    doc = F.to_json(F.struct(F.create_map(key, value).alias("bill")))
    return t.orders.select("o_orderkey", paths.near_miss(doc, "bill.total").alias("written"))


def line_documents(t: Tables) -> DataFrame:
    """One JSON document an order: its lines (an order has few), each with quantity, price where it is not returned, and marks."""
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"), F.array("l_returnflag", "l_linestatus").alias("marks"),
    )
    return t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(line)).alias("lines"))).alias("doc"))


_LINES = """WITH d AS (SELECT l_orderkey, '{"lines":[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || ',"qty":' || l_quantity::INT || CASE WHEN l_returnflag <> 'R' THEN ',"price":' || l_extendedprice::DECIMAL(12,2) ELSE '' END
  || ',"marks":["' || l_returnflag || '","' || l_linestatus || '"]}', ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) || ']}' AS doc FROM lineitem GROUP BY 1)"""


@query(
    """SELECT l_orderkey, sum(l_quantity::INT)::BIGINT AS quantity, count(*) FILTER (WHERE l_returnflag = 'R')::INT AS n_without_price, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN sum(l_extendedprice::DECIMAL(12,2))::DOUBLE END AS total FROM lineitem GROUP BY 1"""
)
def each_line(t: Tables) -> DataFrame:
    """Sums over one field of every line of a document; a line without the field leaves no sum."""
    docs = line_documents(t)
    rows = docs.select("l_orderkey", paths.each(F.col("doc"), "lines", "qty", "long").alias("q"), paths.each(F.col("doc"), "lines", "price", "decimal(12,2)").alias("p"))
    add = lambda x, kind: F.aggregate(x, F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind))
    return rows.select("l_orderkey", add("q", "bigint").alias("quantity"), F.size(F.filter("p", F.isnull)).alias("n_without_price"), add("p", "decimal(18,2)").cast("double").alias("total"))


@query(_LINES + """ SELECT l_orderkey, fullkey AS path, json_extract_string(atom, '$') AS value FROM d, json_tree(d.doc) WHERE type = 'VARCHAR'""")
def document_texts(t: Tables) -> DataFrame:
    """Every text in a document, however deep, with its path."""
    return paths.leaves(line_documents(t), "doc", ["l_orderkey"], texts_only=True).select("l_orderkey", "path", "value")


_PLACES = """WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN '{"net":' || o_totalprice::DECIMAL(12,2) || ',"totals":{"Amount":1}}' WHEN 'F' THEN '{"bill":{"totals":{"net":' || o_totalprice::DECIMAL(12,2) || ',"amount":2},"x":[{"y":{"net":3}}]}}' ELSE '{"bill":{"total":' || o_totalprice::DECIMAL(12,2) || '}}' END AS doc FROM orders)"""


@query(
    _PLACES
    + """, n AS (SELECT o_orderkey, fullkey, json_extract_string(atom, '$')::DOUBLE AS value, lower(key) AS k, length(regexp_replace(fullkey, '[^.\\[]', '', 'g')) AS depth FROM d, json_tree(d.doc) WHERE atom IS NOT NULL)
SELECT o_orderkey, fullkey AS path, value FROM n WHERE k IN ('amount', 'net') QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY depth, k, fullkey) = 1"""
)
def deep_amounts(t: Tables) -> DataFrame:
    """The amount of documents of three shapes, found by its names at the least depth."""
    total = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    flat = F.concat(F.lit('{"net":'), total, F.lit(',"totals":{"Amount":1}}'))
    deep = F.concat(F.lit('{"bill":{"totals":{"net":'), total, F.lit(',"amount":2},"x":[{"y":{"net":3}}]}}'))
    other = F.concat(F.lit('{"bill":{"total":'), total, F.lit("}}"))
    status = F.col("o_orderstatus")
    docs = t.orders.select("o_orderkey", F.when(status == "O", flat).when(status == "F", deep).otherwise(other).alias("doc"))
    return paths.shallowest(docs, "doc", ["o_orderkey"], ["amount", "net"]).withColumn("value", F.col("value").cast("double"))


_PATTERNS = {
    "$..qty": r"\$.*\.qty", "$.lines[*].marks[0]": r"\$\.lines\[[0-9]+\]\.marks\[0\]", "lines[1].*": r"\$\.lines\[1\]\.[a-z]+", "$..marks[*]": r"\$.*\.marks\[[0-9]+\]",
    "lines[0].part": r"\$\.lines\[0\]\.part", "$..*": r"\$.+", "$..none": "x", "$.deep..net": r"\$\.deep\..*net",
}
_DEEP = '{"a":[[{"b":{"c":{"d":[{"net":'


@query(
    _LINES + f""", e AS (SELECT l_orderkey, left(doc, length(doc) - 1) || ',"deep":{_DEEP}' || l_orderkey || '}}]}}}}}}]]}}}}' AS doc FROM d), n AS (SELECT l_orderkey, fullkey, lower(type) AS type, json_extract_string(e.doc, fullkey) AS value FROM e, json_tree(e.doc)),
p AS (SELECT unnest([{", ".join(f"'{p}'" for p in _PATTERNS)}]) AS pattern, unnest([{", ".join(f"'{r}'" for r in _PATTERNS.values())}]) AS r),
m AS (SELECT l_orderkey, pattern, count(*) AS n, max(fullkey) AS path, max(value) AS value FROM n JOIN p ON regexp_full_match(fullkey, r) GROUP BY ALL)
SELECT e.l_orderkey, p.pattern, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n = 1 THEN value END AS value FROM e CROSS JOIN p LEFT JOIN m ON m.l_orderkey = e.l_orderkey AND m.pattern = p.pattern"""
)
def path_counts(t: Tables) -> DataFrame:
    """How many values eight paths lead to in each order's document, with wildcards and at any depth, and single ones."""
    deep = F.concat(F.lit(f',"deep":{_DEEP}'), F.col("l_orderkey").cast("string"), F.lit("}]}}}]]}}"))
    docs = line_documents(t).select("l_orderkey", F.concat(F.expr("left(doc, length(doc) - 1)"), deep).alias("doc"))
    return paths.path_matches(docs, "doc", ["l_orderkey"], list(_PATTERNS)).drop("kind")
