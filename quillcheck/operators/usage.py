"""Replies against billed usage, changes of model, and claims against the evidence before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def by_id(replies: DataFrame, billed: DataFrame, reply_id: str, billed_id: str, seq: str) -> DataFrame:
    """Replies with the billed row of the same id, where exactly one has it."""
    once = billed.groupBy(billed_id).agg(F.count("*").alias("_n"), F.first(seq).alias("row")).where("_n = 1").drop("_n")
    return replies.join(once, F.col(reply_id) == F.col(billed_id), "left").drop(billed_id)


def by_time_and_tokens(replies: DataFrame, billed: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Pairs of a reply and a billed row of equal keys at most ``seconds`` apart, with how many partners either has.

    Times are cut into buckets of that length and a reply looks in its own and the two beside it, so the join is an
    equality; each reply is repeated three times, whatever the spread.
    """
    bucket = F.floor(F.col(ts).cast("double") / seconds).cast("long")
    left = replies.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = billed.withColumn("_b", bucket)
    left, right = left.withColumnRenamed(ts, "reply_time"), right.withColumnRenamed(ts, "billed_time")
    pairs = left.join(right, [*keys, "_b"]).where(F.abs(F.col("reply_time") - F.col("billed_time")) <= seconds).drop("_b")
    return pairs.withColumns(
        {"n_rows": F.count("*").over(W.partitionBy("reply")), "n_replies": F.count("*").over(W.partitionBy("row"))}
    )


def by_bucket(replies: DataFrame, billed: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """Replies summed by bucket against billed buckets: short if less was billed than replied, exact if equal, contained
    if more, absent on either side."""
    ours = replies.groupBy(*keys).agg(F.sum(tokens).alias("replied"), F.count("*").alias("n_replies"), F.count(tokens).alias("n_known"))
    both = ours.join(billed, keys, "full_outer")
    kind = (
        F.when(F.col("billed").isNull(), "NOT_BILLED").when(F.col("replied").isNull(), "NO_REPLIES").when(F.col("billed") < F.col("replied"), "SHORT")
        .when((F.col("billed") == F.col("replied")) & (F.col("n_replies") == F.col("n_known")), "EXACT").otherwise("CONTAINED")
    )
    return both.select(*keys, F.coalesce("n_replies", F.lit(0)).alias("n_replies"), "replied", "billed", kind.alias("match"))


#: Levels of cells: intervals of up to 2 ** LEVELS units.
LEVELS = 40


def _cells(start: Column, end: Column) -> Column:
    """The fewest aligned intervals of 2 ** level units that make up [start, end), two of a level at most: (level, cell)."""
    none = F.expr("cast(array() as array<struct<level: int, cell: bigint>>)")
    first = F.struct(start.alias("a"), end.alias("b"), none.alias("cells"))

    def level(at: Column, k: Column) -> Column:
        a, b = at["a"], at["b"]
        cell = lambda x: F.array(F.struct(k.cast("int").alias("level"), x.cast("bigint").alias("cell")))
        left, right = (a < b) & (a % 2 != 0), (a < b) & (b % 2 != 0)
        found = F.concat(at["cells"], F.when(left, cell(a)).otherwise(none), F.when(right & ~(left & (b - 1 == a)), cell(b - 1)).otherwise(none))
        half = lambda x: F.shiftright(x, 1)
        return F.struct(half(F.when(left, a + 1).otherwise(a)).alias("a"), half(F.when(right, b - 1).otherwise(b)).alias("b"), found.alias("cells"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), first, level)["cells"]


def by_mixed_buckets(replies: DataFrame, billed: DataFrame, keys: list[str], unit: int = 60) -> DataFrame:
    """Replies (keys, at, tokens) against billed intervals (keys, start, end, billed) of any widths; times are whole seconds.

    Per billed interval its replies' sum and ``match`` as in ``by_bucket``, and how much that says (``confidence``: minute,
    hour or day, by its width); intervals that overlap are judged each by itself. Replies that no interval holds are
    summed by unit, as NOT_BILLED. Bounds must be multiples of ``unit``: an interval of others, or an empty one, is
    UNALIGNED. Replies without time or keys are left out, those without tokens count as replies of unknown size.

    An interval is cut into cells of powers of two units, some twenty for a day of minutes; replies are summed by unit and
    then by the cells of the levels in use, and cells meet by equality. So no reply is paired with an interval, and a
    second with a third of all replies costs one row.
    """
    bound = ["start", "end", "billed"]
    rows = billed.select(*keys, *bound).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(rows)
    aligned = (F.col("start") % unit == 0) & (F.col("end") % unit == 0) & (F.col("start") < F.col("end"))
    cells = rows.where(aligned).select(*keys, "_id", F.inline(_cells((F.col("start") / unit).cast("bigint"), (F.col("end") / unit).cast("bigint"))))
    cells = cut(cells)
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # LEVELS at most
    at = F.floor(F.col("at") / unit)
    units = replies.where(F.col("at").isNotNull()).groupBy(*keys, at.alias("_u")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count("tokens").alias("known"))
    units = cut(units)
    level = F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)")).alias("level")
    spread = units.select("*", level).withColumn("cell", F.expr("shiftright(_u, level)"))
    by_cell = spread.groupBy(*keys, "level", "cell").agg(*[F.sum(c).alias(c) for c in ("t", "n", "known")])
    sums = cells.join(by_cell, [*keys, "level", "cell"]).groupBy("_id").agg(F.sum("t").alias("replied"), F.sum("n").alias("n_replies"), F.sum("known").alias("known"))
    out = rows.join(sums, "_id", "left")
    width = F.col("end") - F.col("start")
    match = (
        F.when(~F.coalesce(aligned, F.lit(False)), "UNALIGNED").when(F.col("n_replies").isNull(), "NO_REPLIES").when(F.col("billed") < F.col("replied"), "SHORT")
        .when((F.col("billed") == F.col("replied")) & (F.col("n_replies") == F.col("known")), "EXACT").otherwise("CONTAINED")
    )
    said = F.when(width <= 60, "minute").when(width <= 3600, "hour").otherwise("day")
    out = out.select(*keys, "start", "end", F.coalesce("n_replies", F.lit(0)).alias("n_replies"), "replied", "billed", match.alias("match"), said.alias("confidence"))
    held = spread.join(cells.select(*keys, "level", "cell").distinct(), [*keys, "level", "cell"], "left_semi").select(*keys, "_u").distinct()
    lost = units.join(held, [*keys, "_u"], "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    lost = lost.select(
        *keys, (F.col("_u") * unit).alias("start"), (F.col("_u") * unit + unit).alias("end"), F.col("n").alias("n_replies"), F.col("t").alias("replied"),
        none(rows.schema["billed"].dataType).alias("billed"), F.lit("NOT_BILLED").alias("match"), none("string").alias("confidence"),
    )
    return out.unionByName(lost)


def switches(events: DataFrame, keys: list[str], order: list[str], model: str) -> DataFrame:
    """Consecutive events whose model differs, with the one before and how many events it had lasted."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = events.withColumn("_was", F.lag(model).over(w)).withColumn("_at", F.row_number().over(w))
    changed = marked.where(F.col("_was").isNotNull() & (F.col("_was") != F.col(model)))
    since = F.col("_at") - F.coalesce(F.lag("_at").over(w), F.lit(1))
    return changed.withColumn("lasted", since).withColumnRenamed("_was", "from_model").drop("_at")


def evidence_before(steps: DataFrame, keys: list[str], order: str, claim: Column, evidence: Column, spoils: Column) -> DataFrame:
    """Claims with the last evidence before each and whether it still stands: it does not if something spoiled it since."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    at = F.col(order)
    rows = steps.withColumns(
        {"evidence_at": F.max(F.when(evidence, at)).over(w), "spoiled_at": F.max(F.when(spoils, at)).over(w), "_claim": claim}
    ).where("_claim").drop("_claim")
    verdict = F.when(F.col("evidence_at").isNull(), "NO_EVIDENCE").when(F.col("spoiled_at") > F.col("evidence_at"), "STALE").otherwise("SUPPORTED")
    return rows.withColumn("support", verdict)
