"""Queries on forms of texts, lines that labels head, draws and orders of options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger
from .registry import Tables, query

_BLANKS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    rf"""WITH c AS (SELECT doc_id, text, replace(translate(regexp_replace(text, '\x{{ad}}\s*', '', 'g'), '‐‑‒–—―−‘’‚‛′“”„‟″', '-------''''''''''"""
    + r'"""""'
    + rf"""'), '…', '...') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(t, '(\pL)-[ \t]*\r?\n[ \t\r\n]*(\p{{Ll}})', '\1\2', 'g'), '{_BLANKS}', ' ', 'g')) AS t FROM c)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '{_BLANKS}', ' ', 'g'), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g'))) AS description, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS n_tokens, md5(t) AS canonical FROM k"""
)
def canonical_forms(t: Tables) -> DataFrame:
    """Hashes of each document's canonical text and of its form as a description, and its canonical tokens counted."""
    rows = t.documents.where("text is not null").select("doc_id", text.description("text").alias("d"), text.canonical("text").alias("t"))
    n = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " ")))
    return rows.select("doc_id", F.md5("d").alias("description"), n.alias("n_tokens"), F.md5("t").alias("canonical"))


_LABELS = ("license", "the", "die", "el", "email")


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, line, trim(regexp_replace(raw, '{_BLANKS}', ' ', 'g')) AS t FROM l), k AS (SELECT unnest({list(_LABELS)!r}) AS label, unnest(range({len(_LABELS)})) AS n),
h AS (SELECT *, t[len(label) + 1:] AS rest FROM s JOIN k ON starts_with(lower(t), label))
SELECT doc_id, line::INT AS line, label, t AS text FROM h WHERE NOT regexp_matches(rest, '^[\pL\pN]') AND NOT (regexp_matches(trim(rest), '^\p{{Ll}}+( |$)') AND NOT regexp_matches(rest, '\pN')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line, n) = 1"""
)
def label_lines(t: Tables) -> DataFrame:
    """The first line of each document that one of some labels heads."""
    rows = t.documents.select("doc_id", text.label_line("text", _LABELS).alias("r")).where("r is not null")
    return rows.select("doc_id", "r.*")


@query("""SELECT row_number() OVER (ORDER BY sha256('audit:' || o_orderkey))::INT AS rank, o_orderkey FROM orders QUALIFY rank <= 50""")
def audit_draw(t: Tables) -> DataFrame:
    """Fifty orders drawn for an audit by a seed."""
    return ledger.bottom_k(t.orders, "o_orderkey", "audit", 50)


@query(
    """WITH k AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS k FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, unnest([0, 1, 2, 3]) AS n, k FROM k),
s AS (SELECT l_orderkey, CASE n WHEN 0 THEN k WHEN 1 THEN list_reverse(k) ELSE list_transform(list_sort(list_transform(k, lambda x: md5(concat_ws(':', l_orderkey, n, x)) || x)), lambda x: x[33:]::BIGINT) END AS k FROM o)
SELECT l_orderkey, count(DISTINCT k)::INT AS n_orders, md5(array_to_string(list_sort(list_distinct(list(array_to_string(k, ',')))), ';')) AS orders FROM s GROUP BY 1"""
)
def option_orders(t: Tables) -> DataFrame:
    """In which orders the parts of each order would be shown to a reader, at most four."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("k"))
    rows = rows.select("l_orderkey", ledger.schedules(F.col("k"), 4, F.col("l_orderkey").cast("string")).alias("s"))
    listed = F.array_sort(F.transform("s", lambda o: F.array_join(o.cast("array<string>"), ",")))
    return rows.select("l_orderkey", F.size("s").alias("n_orders"), F.md5(F.array_join(listed, ";")).alias("orders"))
