"""Host-level quality rules: rule failures aggregated by host, shrunk, and joined back. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A host is hot if it has over one in HOT documents; so there are at most HOT hot hosts, whatever the corpus.
HOT = 2000

#: A rule is true where a document fails it. Sizes are of the whole text.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)",
}
BASE = ("short", "repeated")

#: Words of 3-word windows found twice or more, from ``_w``, the array of words. Windows are hashed; where some hash
#: repeats, (hash, place) pairs are sorted, windows beside an equal one are kept, and their places are merged.
REPEATS = """
if(size(_w) < 3, 0L, element_at(transform(array(
  transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))), h ->
  if(size(array_distinct(h)) = size(h), 0L, element_at(transform(array(
    sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    aggregate(
      sort_array(transform(filter(s, (a, k) -> (k > 0 AND s[k - 1].x = a.x) OR (k < size(s) - 1 AND s[k + 1].x = a.x)), a -> a.i)),
      struct(0L AS n, -3 AS last),
      (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last),
      a -> a.n)), 1))), 1))
"""


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_lines and n_dup_lines (of lines with a word), and
    n_repeat_words of each row's whole text; null counts as empty, which has none of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, BLANK), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  value is computed once
    counted = once(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    symbols = F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", ""))
    repeats = F.expr(f"element_at(transform(array(_words), _w -> {REPEATS}), 1)")
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        counted.alias("_lines"),
        repeats.alias("n_repeat_words"),
    )
    n, distinct = F.col("_lines.n").cast("long"), F.col("_lines.d").cast("long")
    return rows.withColumn("n_lines", n).withColumn("n_dup_lines", n - distinct).drop("_lines")


def host_rates(failures: DataFrame, host: str, rules: list[str], spread: float = 2.0) -> DataFrame:
    """Per host its shrunk failure rate of each rule, shrunk_<rule>, and host_failed.

    ``failures`` has one row per host: n, and the failures of each rule. For each rule a beta prior is fitted to all
    hosts by moments: mean m = failures / documents, variance v of the hosts' rates about m weighted by n, less what
    binomial noise explains, strength s = m (1 - m) / v - 1 held between 1 and 1000000. A host's rate is
    (failures + m s) / (n + s), so a host of few documents says little. A host fails if for some rule that rate is over
    m + ``spread`` standard deviations of the prior, sqrt(m (1 - m) / (s + 1)): it is worse than hosts of this corpus
    are. Where hosts differ by no more than chance the prior is narrow and strong, and only many documents make a host
    fail. Two numbers a rule come to the driver.
    """
    total = failures.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *[F.sum(r).alias(r) for r in rules]).first()
    n, hosts = float(total.n or 1), total.hosts
    mean = {r: (total[r] or 0) / n for r in rules}
    off = [F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(mean[r]), F.lit(2))).alias(r) for r in rules]
    apart = failures.agg(*off).first()
    out, failed = failures, F.lit(False)
    for r in rules:
        m = mean[r]
        v = ((apart[r] or 0.0) - (hosts - 1) * m * (1 - m)) / n
        s = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
        out = out.withColumn(f"shrunk_{r}", (F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s)))
        failed = failed | (F.col(f"shrunk_{r}") > m + spread * (m * (1 - m) / (s + 1)) ** 0.5)
    return out.select(host, "n", *rules, *[f"shrunk_{r}" for r in rules], failed.alias("host_failed"))


def host_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    spread: float = 2.0,
    rules: dict[str, str] = RULES,
    base: tuple[str, ...] = BASE,
) -> DataFrame:
    """Per row: the id, its text statistics, base_failed, host_failed and kept.

    A host fails if its shrunk failure rate of any rule is over the mean of all by ``spread`` standard deviations of the
    prior (see ``host_rates``); a document is kept if it fails no ``base`` rule itself and its host does not fail. The
    statistics (some numbers a document, no text) are stored once, as they are aggregated by host and joined back. One
    host may hold most rows: its failures are summed before the shuffle, and in the join back hot hosts (at most HOT)
    are sent to the documents, which are not shuffled.

    Null text counts as empty and fails as short. Documents with a null host share one. Repeated rows count as rows of
    their own. No rows give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_t"))
    stats = cut(text_statistics(rows, ["_id", "_host"], "_t"))
    key = F.when(F.col("_host").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("_host").cast("string")))
    stats = stats.withColumn("_host", key)
    counts = [F.count("*").alias("n"), *[F.sum(F.expr(f"bigint({e})")).alias(r) for r, e in rules.items()]]
    failures = cut(stats.groupBy("_host").agg(*counts))
    verdicts = host_rates(failures, "_host", list(rules), spread).select("_host", "n", "host_failed")
    most = (failures.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(verdicts.where(F.col("n") > most).drop("n"))
    cold = stats.join(hot, "_host", "left_anti").join(verdicts.where(F.col("n") <= most).drop("n"), "_host")
    stats = stats.join(hot, "_host").unionByName(cold)
    base_failed = F.expr(" OR ".join(f"({rules[r]})" for r in base) or "false")
    stats = stats.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select(F.col("_id").alias(id_col), *numbers, "base_failed", "host_failed", kept.alias("kept"))


_FAILED = " OR ".join(
    f"(f.{r} + {m} * {s}) / (f.n + {s}) > {m} + 2 * sqrt({m} * (1 - {m}) / ({s} + 1))"
    for r in RULES
    for m in [f"(p.f_{r} / p.n)"]
    for v in [f"((p.v_{r} - (p.hosts - 1) * {m} * (1 - {m})) / p.n)"]
    for s in [f"(CASE WHEN {v} > 0 THEN least(greatest({m} * (1 - {m}) / nullif({v}, 0) - 1, 1.0), 1e6) ELSE 1e6 END)"]
)
SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS host, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, row_number() OVER () AS rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
g AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM g),
u AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY rid),
s AS (
  SELECT w.rid, doc_id, host, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN u USING (rid)),
f AS (SELECT host, count(*)::DOUBLE AS n, {", ".join(f"sum(({e})::INT)::DOUBLE AS {r}" for r, e in RULES.items())} FROM s GROUP BY host),
t AS (SELECT sum(n) AS n, count(*)::DOUBLE AS hosts, {", ".join(f"sum({r}) AS f_{r}" for r in RULES)} FROM f),
p AS (
  SELECT t.*, {", ".join(f"v.v_{r}" for r in RULES)} FROM t,
    (SELECT {", ".join(f"sum(f.n * pow(f.{r} / f.n - t.f_{r} / t.n, 2)) AS v_{r}" for r in RULES)} FROM f, t) v),
h AS (SELECT f.host, {_FAILED} AS host_failed FROM f, p),
b AS (SELECT s.*, ({RULES["short"]}) OR ({RULES["repeated"]}) AS base_failed, h.host_failed FROM s JOIN h USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM b
"""
