"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

WORD = r"[^\x20\x09-\x0D]+"
_MINE = ("_size", "_source", "_class", "_slice", "_key")
#: Rows of one source and size that a task orders, about; more are dealt by the digits of their hashes.
SLICE = 65_536
_IN_PARTITION = (1 << 33) - 1


def _named(text: Column) -> Column:
    """A key without null, in the order of code points, null last."""
    return F.when(text.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), text))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, extra: list[str]) -> DataFrame:
    """Each document with its source, size and the hash of its id."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(*extra, _named(F.col(source_col)).alias("_source"), size.alias("_size"), key.alias("_key"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source its source_size and target words.

    ``sizes`` has one row per source (_source, source_size). The sources in order weigh as ``weights`` repeats and share
    all words; a target stops at cap times its source's size and the excess goes to the others by weight. The fixed
    point is min(cap * size, weight * level) with one level for all. It is found from below: sums over the sources give a
    level, the sources that stop under it give the next one, until none stops any more. Sources are sorted over all
    tasks; a place is one's number in its part and the rows of the parts before, of which only counts come to the driver.
    """
    number = F.monotonically_increasing_id()
    rows = sizes.orderBy("_source").select("_source", "source_size", F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit(_IN_PARTITION)).alias("_at"))
    rows = cut(rows)
    before, total = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("_part").count().collect())):
        before += [F.lit(part), F.lit(total)]
        total += n
    place = F.col("_at") + (F.element_at(F.create_map(*before), F.col("_part")) if before else 0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = rows.select("_source", "source_size", weight.cast("long").alias("_weight"), (F.col("source_size") * cap).alias("_cap"))
    rows = cut(rows.withColumn("_stops", F.col("_cap") / F.col("_weight")))
    level, last = None, -1.0
    while level != last:
        open_ = F.lit(True) if level is None else F.col("_stops") >= F.lit(level)
        sums = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(open_, 0).otherwise(F.col("_cap"))).alias("stopped"), F.sum(F.when(open_, F.col("_weight"))).alias("weight")).first()
        last, level = level, float((sums["all"] or 0) - (sums["stopped"] or 0)) / float(sums["weight"] or 1)
    target = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))
    return rows.select("_source", "source_size", target.alias("target"))


def _before(n: str, within: list[str], order: str) -> Column:
    """Sum of n over the rows that come before in the order."""
    window = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(window), F.lit(0))


def mix(
    docs: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 42,
    slice_rows: int = SLICE,
) -> DataFrame:
    """The columns ``keep`` of every document with size, source_size, target and copies.

    Every document of a source expects target / source_size copies. The expected copies are summed along the source,
    in the order of size and of the id's hash, one offset per source drawn from the seed is added, and a document is taken
    once for each integer that its share of the sum crosses. As sizes rise along the order, each document taken stands
    for those right before or after it, so a source's words are off its target by less than its largest document; as a
    target is at most cap times its source, a document is taken at most cap times.

    No task needs a whole source: a place is the rows of smaller size classes, of smaller sizes in the class, of earlier
    slices of the size, and the place in the slice. Slices are digits of the hash, as many as leave about ``slice_rows``
    rows of one source and size in each. Sizes and hashes are stored once, without texts.

    Null text has size 0; a null source is a source of its own, the last. A source without words has target 0 and none
    of its documents is taken. Repeated rows are sampled as rows of their own. No rows give no rows. Reruns agree:
    rows that tie in all of the order are alike in size, and if their ids differ their hashes do.
    """
    extra = [c for c in dict.fromkeys(keep) if c not in _MINE]
    light = set(extra) <= {id_col, source_col}
    rows = _sized(docs, id_col, text_col, source_col, extra)
    stored = cut(rows if light else _sized(docs, id_col, text_col, source_col, []))
    rows = stored if light else rows

    by_size = cut(stored.groupBy("_source", "_size").agg(F.count("*").alias("_n")))
    targets = by_size.groupBy("_source").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size"))
    targets = source_targets(targets, weights, cap)
    fullest = by_size.agg(F.max("_n")).first()[0] or 0
    digits = next(d for d in range(33) if d == 32 or fullest <= slice_rows * 16**d)
    slice_ = F.substring("_key", 1, digits)

    size_class = F.when(F.col("_size") > 0, F.floor(F.log2(F.col("_size")) * 4 + 1e-9)).otherwise(-1).cast("int")
    by_size = by_size.withColumn("_class", size_class)
    by_class = by_size.groupBy("_source", "_class").agg(F.sum("_n").alias("_m"))
    by_class = by_class.select("_source", "_class", _before("_m", ["_source"], "_class").alias("_base")).join(targets, "_source")
    by_size = by_size.withColumn("_b", _before("_n", ["_source", "_class"], "_size")).join(by_class, ["_source", "_class"])
    by_size = by_size.select("_source", "_size", "source_size", "target", (F.col("_base") + F.col("_b")).alias("_base"))
    strata = stored.groupBy("_source", "_size", slice_.alias("_slice")).agg(F.count("*").alias("_n"))
    strata = strata.withColumn("_b", _before("_n", ["_source", "_size"], "_slice")).join(by_size, ["_source", "_size"])

    inside = W.partitionBy("_source", "_size", "_slice").orderBy("_key")
    rows = rows.withColumn("_slice", slice_).withColumn("_place", F.row_number().over(inside) - 1)
    rows = rows.join(strata.drop("_n"), ["_source", "_size", "_slice"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_source"))), 1, 8)
    offset = F.conv(draw, 16, 10).cast("long") / F.lit(4294967296.0)
    place = F.col("_base") + F.col("_b") + F.col("_place")
    copies = F.floor(rate * (place + 1) + offset) - F.floor(rate * place + offset)
    return rows.select(*extra, F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def mixture_report(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """Per document: id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(docs, [id_col], id_col=id_col, **more).select(id_col, "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, **more) -> DataFrame:
    """The documents of the mix with their own columns, one row for each time that one is taken."""
    columns = docs.columns
    used = {more.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = mix(docs.select(F.struct(*columns).alias("_row"), *used), ["_row"], **more)
    again = F.explode(F.expr("array_repeat(true, cast(copies as int))"))
    return taken.select("_row", again.alias("_again")).select("_row.*")


SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
w AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
v AS (SELECT *, ((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, s
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM v),
t AS (
  SELECT s, source_size, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE cap::DOUBLE / weight >= level
         ORDER BY cap::DOUBLE / weight, s LIMIT 1)) AS target
  FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.s ORDER BY size, k) - 1 AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('42|' || d.s), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS o
  FROM d JOIN t USING (s))
SELECT doc_id, size, source_size, target,
       (size * (floor(rate * (place + 1) + o) - floor(rate * place + o)))::BIGINT AS taken
FROM p
"""
