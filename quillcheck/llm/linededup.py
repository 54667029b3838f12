"""Line dedup by overlapping three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of ``_text`` with a word, in order: the line without outer blanks, and its place among all lines.
LINES = r"""
filter(transform(split(_text, '\n'), (x, i) -> struct(trim(BOTH '\t\n\x0B\f\r ' FROM x) AS x, i AS i)), a -> length(a.x) > 0)
"""
LINES = LINES.replace(r"\x0B", "\x0b").replace(r"\f", "\f")
#: The windows of those lines, ``_l``: two hashes of the three lines, and the first and last line's places.
WINDOWS = """
if(size(_l) < 3, array(), transform(sequence(0, size(_l) - 3), k -> struct(
  xxhash64(_l[k].x, _l[k + 1].x, _l[k + 2].x) AS a, xxhash64(_l[k + 2].x, '|', _l[k + 1].x, '|', _l[k].x) AS b,
  k AS k, _l[k].i AS first, _l[k + 2].i AS last)))
"""


def _kept(x: Column) -> Column:
    """What stays of the lines ``x.n`` once the spans ``x.s`` (sorted, apart from one another) are taken out."""
    n, s = x["n"], x["s"]

    def piece(j: Column) -> Column:
        begin = F.when(j == 0, 0).otherwise(F.get(s, j - 1)["last"] + 1)
        end = F.when(j == F.size(s), F.size(n)).otherwise(F.get(s, j)["first"])
        return F.slice(n, begin + 1, end - begin)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), piece)), "\n")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with repeated windows: _id, _hash (of the text) and _spans, the lines to remove as sorted runs
    (first, last), places from 0. Null texts have no windows; no rows give no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    windows = rows.select(
        "_id", "_hash", F.explode(F.expr(f"element_at(transform(array({LINES}), _l -> {WINDOWS}), 1)")).alias("_w")
    ).select("_id", "_hash", "_w.*")
    place = F.struct("_id", "_hash", "k")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    firsts = firsts.where(F.col("_first") < F.col("_last")).drop("_last")
    later = windows.join(firsts, ["a", "b"]).where(place > F.col("_first")).dropDuplicates(["_id", "_hash", "k"])
    order = W.partitionBy("_id", "_hash").orderBy("k")
    fresh = F.coalesce(F.col("k") - F.lag("k").over(order) > 3, F.lit(True))
    runs = later.withColumn("_run", F.sum(fresh.cast("int")).over(order)).groupBy("_id", "_hash", "_run")
    spans = runs.agg(F.min("first").alias("first"), F.max("last").alias("last")).groupBy("_id", "_hash")
    return spans.agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_spans"))


RESULTS = ("n_lines", "n_removed", "n_spans")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """The rows of ``docs``, texts without repeated windows, with n_lines, n_removed and n_spans (named by ``results``).

    A window is three consecutive lines with a word, compared without outer blanks; lines without a word stand in none,
    and go only when they lie inside a removed run. The first occurrence of a window, by id and place, stays; the lines
    of every later one go, and windows that overlap or touch go as one run. Counts, first occurrences and joins are by
    window hash (128 bits), so no group is collected; a window that stands in a third of all documents is reduced
    before the shuffle, and its join is left to be split as a skewed one.

    Documents of fewer than three such lines stay whole, also when equal to another. Null text counts as empty (one
    line, none removed) but stays null. Rows equal in id and text count as one document and get the same result; rows
    that share only the id are ordered by a hash of the text. A null id comes first. Other columns pass through; one that
    has the name of a result (in any case) is refused with a ValueError, and ``results`` takes other names. No rows give
    no rows.
    """
    taken = {c.lower() for c in docs.columns} & {c.lower() for c in results}
    if taken:
        raise ValueError(f"columns named like results: {sorted(taken)}")
    spans = repeated_spans(docs, id_col, text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(whole.alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"))
    same = rows["_id"].eqNullSafe(spans["_id"]) & (rows["_hash"] == spans["_hash"])
    rows = rows.join(spans, same, "left").select("_row", "_spans")
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n")
    taken_out = F.element_at(F.transform(F.array(F.struct(lines.alias("n"), F.col("_spans").alias("s"))), _kept), 1)
    kept = F.when(F.col("_spans").isNull(), F.col(f"_row.`{text_col}`")).otherwise(taken_out)
    removed = F.expr("coalesce(aggregate(_spans, 0L, (a, x) -> a + x.last - x.first + 1), 0L)")
    numbers = (F.size(lines).cast("long"), removed, F.coalesce(F.size("_spans"), F.lit(0)).cast("long"))
    others = [kept.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns]
    return rows.select(*others, *[v.alias(k) for k, v in zip(results, numbers)])


def deduped_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their own columns, texts as by ``dedup_lines``. ``length_col``, if there, is the new
    text's length where lines were removed. A document that lost lines and has no word left goes."""
    columns = docs.columns
    inner = [f"_c{k}" for k in range(len(columns))]  # so that no column can clash with a result
    own = dict(zip(columns, inner))
    rows = dedup_lines(docs.toDF(*inner), own[id_col], own[text_col])
    kept = rows.where((F.col("n_removed") == 0) | F.col(own[text_col]).rlike(r"[^\x20\x09-\x0D]"))
    if length_col in own:
        name, kind = own[length_col], docs.schema[length_col].dataType
        length = F.when(F.col("n_removed") > 0, F.length(own[text_col])).otherwise(F.col(name))
        kept = kept.withColumn(name, length.cast(kind))
    return kept.select(*inner).toDF(*columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_lines, n_removed, n_spans and kept_sha256 of the text that stays (null: of the empty text)."""
    rows = dedup_lines(docs.select(id_col, text_col), id_col, text_col)
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return rows.select(id_col, "n_lines", "n_removed", "n_spans", digest.alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
a AS (SELECT rid, doc_id, string_split(t, chr(10)) AS ls FROM d),
e AS (SELECT rid, doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM a),
l AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS k
  FROM (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM e) WHERE x <> ''),
w AS (
  SELECT rid, doc_id, k, i AS first, lead(i, 2) OVER o AS last, [x, lead(x) OVER o, lead(x, 2) OVER o] AS win
  FROM l WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w WHERE last IS NOT NULL),
r AS (SELECT *, k - lag(k) OVER (PARTITION BY rid ORDER BY k) AS gap FROM f WHERE nth > 1),
g AS (SELECT *, sum(CASE WHEN gap <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY k) AS run FROM r),
s AS (SELECT rid, run, min(first) AS first, max(last) AS last FROM g GROUP BY rid, run),
n AS (SELECT rid, count(*) AS n_spans, sum(last - first + 1) AS n_removed FROM s GROUP BY rid),
h AS (
  SELECT e.rid, sha256(string_agg(raw, chr(10) ORDER BY i)) AS sha FROM e
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rid = e.rid AND e.i BETWEEN s.first AND s.last) GROUP BY e.rid)
SELECT a.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(h.sha, sha256('')) AS kept_sha256
FROM a LEFT JOIN n USING (rid) LEFT JOIN h USING (rid)
"""
