"""Rules mined from labelled cases: tallies of candidate rules in one pass, learned tolerances and cuts, and judges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def tally(cases: DataFrame, label: Column, candidates: dict[str, Column]) -> DataFrame:
    """Per candidate rule: decidable cases, holds among them, violators, holds among those, approvals among those.

    ``label`` is true for a case that was held; a candidate is true where a case violates it and null where that cannot be
    told. All candidates are counted in one pass over the cases, as a fixed number of sums.
    """
    out = []
    for name, violated in candidates.items():
        told = violated.isNotNull()
        out.append(
            F.struct(
                F.lit(name).alias("rule"), F.count_if(told).alias("n"), F.count_if(told & label).alias("holds"), F.count_if(violated).alias("k"),
                F.count_if(violated & label).alias("k_holds"), F.count_if(violated & ~label).alias("k_approved"),
            )
        )
    return cases.agg(F.array(*out).alias("t")).select(F.inline("t"))


def learned_tolerance(tallies: DataFrame, family: Column, t: Column, allowed_rate: float) -> DataFrame:
    """Per family the smallest tolerance whose violators among approved cases are few enough."""
    ok = F.col("k_approved") <= F.floor(allowed_rate * (F.col("n") - F.col("holds")))
    rows = tallies.withColumns({"family": family, "t": t}).groupBy("family")
    return rows.agg(F.min(F.when(ok, F.col("t"))).alias("t"), F.min_by("k_holds", F.when(ok, F.col("t"))).alias("k_holds"))


def learned_cut(cases: DataFrame, x: str, label: Column, allowed_rate: float) -> DataFrame:
    """The threshold on ``x`` above which cases are held with the fewest errors, if few enough approved cases lie above.

    Cases are summed by value first; cumulative sums over the distinct values give every cut's errors at once. Sums run
    in blocks of values (``learned_cuts`` does so for many fields, by sorted ranges): each block's own, then those of blocks before.
    """
    values = cases.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count_if(label).alias("h"), F.count_if(~label).alias("a"))
    values = values.withColumn("_b", F.floor(F.log2(F.greatest(F.abs("x"), F.lit(1.0))) * 16) * F.signum("x"))
    blocks = values.groupBy("_b").agg(F.sum("h").alias("bh"), F.sum("a").alias("ba"), F.min("x").alias("bx"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        "_b", F.coalesce(F.sum("bh").over(before), F.lit(0)).alias("ph"), F.coalesce(F.sum("ba").over(before), F.lit(0)).alias("pa"),
        F.sum("bh").over(every).alias("th"), F.sum("ba").over(every).alias("ta"), F.lead("bx").over(W.orderBy("_b")).alias("next_x"),
    )
    inside = W.partitionBy("_b").orderBy("x")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = values.join(blocks, "_b").select(
        "x", (F.sum("h").over(upto) + F.col("ph")).alias("below_holds"), (F.sum("a").over(upto) + F.col("pa")).alias("below_approved"), "th", "ta",
        F.coalesce(F.lead("x").over(inside), "next_x").alias("next"),
    )
    above = F.col("ta") - F.col("below_approved")
    good = rows.where(F.col("next").isNotNull() & (above <= F.floor(allowed_rate * F.col("ta"))))
    errors = F.col("below_holds") + above
    place = F.struct(errors.alias("e"), above.alias("a"), F.col("x"))
    return good.agg(F.min(F.struct(place.alias("p"), ((F.col("x") + F.col("next")) / 2).alias("cut"))).alias("m")).select(
        "m.cut", F.col("m.p.e").alias("errors"), F.col("m.p.a").alias("approved_above")
    )


def learned_cuts(cases: DataFrame, fields: list[str], label: Column, allowed_rate: float) -> DataFrame:
    """Per field and direction the constant that parts held from approved cases with the fewest errors: field, op, c, lo, hi,
    approved, missed, fate.

    ``<=`` says that large values violate, ``>=`` that small ones do. Errors are approved violators plus held cases that do
    not violate; a cut may make at most a share ``allowed_rate`` of the approved cases violate, of equal errors the one with
    fewer of these is taken. c lies midway between the values lo and hi on either side. fate is LEARNED, VOID with fewer than
    two values, or INCONSISTENT if every cut has too many approved violators. Missing and non-finite values do not count.

    All fields are learned in one pass: cases are counted by (field, value), the counts sorted over all tasks by ranges, and
    sums of a range's rows added to those of the ranges before, so no task reads a whole field.
    """
    entry = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    rows = cases.select(label.alias("_held"), F.explode(entry).alias("_e")).select("_held", "_e.*")
    rows = rows.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")) & F.col("_held").isNotNull())
    counts = rows.groupBy("field", "x").agg(F.count_if("_held").alias("h"), F.count_if(~F.col("_held")).alias("a"))
    counts = cut(counts.repartitionByRange("field", "x").withColumn("_part", F.spark_partition_id()))
    parts = counts.groupBy("field", "_part").agg(F.sum("h").alias("_h"), F.sum("a").alias("_a"), F.min("x").alias("_first"), F.count("*").alias("_n"))
    order = W.partitionBy("field").orderBy("_part")  # as many rows as there are tasks
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("field")
    parts = parts.select(
        "field", "_part", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_bh"), F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_ba"), F.lead("_first").over(order).alias("_next"),
        F.sum("_h").over(every).alias("all_h"), F.sum("_a").over(every).alias("all_a"), F.sum("_n").over(every).alias("_values"),
    )
    inside = W.partitionBy("field", "_part").orderBy("x")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    sums = counts.withColumns({"_ih": F.sum("h").over(upto), "_ia": F.sum("a").over(upto), "_lead": F.lead("x").over(inside)}).join(parts, ["field", "_part"])
    sums = sums.select("field", "all_h", "all_a", "_values", F.col("x").alias("lo"), F.coalesce("_lead", "_next").alias("hi"), (F.col("_bh") + F.col("_ih")).alias("bh"), (F.col("_ba") + F.col("_ia")).alias("ba"))
    high = F.struct(F.lit("<=").alias("op"), (F.col("all_a") - F.col("ba")).alias("approved"), F.col("bh").alias("missed"))
    low = F.struct(F.lit(">=").alias("op"), F.col("ba").alias("approved"), (F.col("all_h") - F.col("bh")).alias("missed"))
    sums = sums.select("field", "all_a", "_values", "lo", "hi", F.inline(F.array(high, low)))
    fits = F.col("hi").isNotNull() & (F.col("approved") <= F.floor(allowed_rate * F.col("all_a") + 1e-9))
    place = F.struct((F.col("missed") + F.col("approved")).alias("e"), "approved", "lo", "hi", "missed")
    best = sums.groupBy("field", "op").agg(F.min(F.when(fits, place)).alias("b"), F.max("_values").alias("_values"))
    lo, hi = F.col("b.lo"), F.col("b.hi")
    middle = lo + (hi - lo) / 2
    c = F.when((lo < middle) & (middle < hi), middle).when(F.col("op") == "<=", lo).otherwise(hi)
    fate = F.when(F.col("_values") < 2, "VOID").when(F.col("b").isNull(), "INCONSISTENT").otherwise("LEARNED")
    return best.select("field", "op", c.alias("c"), lo.alias("lo"), hi.alias("hi"), F.col("b.approved").alias("approved"), F.col("b.missed").alias("missed"), fate.alias("fate"))


def kth_largest(rows: DataFrame, x: str, share: float) -> float | None:
    """The value that a share of the values exceed: the (floor(share * n) + 1)-th largest, null without values.

    Values are counted in bins that widen with their size; only the bin that holds the place is put in order.
    """
    value = F.col(x).cast("double")
    binned = rows.where(value.isNotNull()).select(value.alias("x"), F.floor(F.asinh(value * 1000) * 64).alias("b"))
    counts = binned.groupBy("b").agg(F.count("*").alias("c"))
    above = F.coalesce(F.sum("c").over(W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("c").over(W.partitionBy())
    place = F.floor(share * total) + 1
    hit = counts.select("b", "c", above.alias("above"), place.alias("place")).where("above < place and place <= above + c").first()
    if hit is None:
        return None
    values = binned.where(F.col("b") == F.lit(hit.b)).groupBy("x").agg(F.count("*").alias("c"))  # equal values count as one row
    passed = values.withColumn("n", F.sum("c").over(W.orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, 0)))
    return passed.where(F.col("n") >= hit.place - hit.above).agg(F.max("x")).first()[0]


def upper_tail(n: int, holds: int, k: int, h: int) -> float:
    """Chance that of k cases drawn from n, of which ``holds`` are held, h or more are held."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    top = min(k, holds)
    if h > top:
        return 0.0
    least = max(h, k - (n - holds))
    return min(1.0, math.fsum(math.exp(choose(holds, i) + choose(n - holds, k - i) - choose(n, k)) for i in range(least, top + 1)))


def cover(held: DataFrame, rules: list[tuple[str, int]], least: int = 1) -> list[tuple[str, int, int]]:
    """Greedy cover over held cases counted by pattern (flags, cases): rules by how many holds they explain, ties in the order
    given, each kept if it explains ``least`` holds or more that no kept one before does; with both numbers.

    ``rules`` names each rule's place in the flags. Patterns stay where they are. A round sums cases by the first rule,
    of those still in, that explains them: if all in front are kept, that sum is what a rule explains anew, so the first
    rule with too little goes, and the round is made again. Only sums by rule come to the driver, one row a rule.
    """
    sign = lambda at: F.substring("flags", at + 1, 1)
    held = cut(held)
    total = held.agg(F.lit(0).alias("none"), *[F.coalesce(F.sum(F.when(sign(at) == "1", F.col("cases"))), F.lit(0)).alias(f"r{k}") for k, (_, at) in enumerate(rules)]).first()
    size = {k: total[f"r{k}"] for k in range(len(rules))}
    left = sorted((k for k in size if size[k] >= least), key=lambda k: -size[k])
    while left:
        first = F.locate("1", F.concat(*[sign(rules[k][1]) for k in left]))
        fresh = {r["first"]: r["cases"] for r in held.groupBy(first.alias("first")).agg(F.sum("cases").alias("cases")).collect()}
        short = next((n for n in range(len(left)) if fresh.get(n + 1, 0) < least), None)
        if short is None:
            return [(rules[k][0], size[k], fresh[n + 1]) for n, k in enumerate(left)]
        del left[short]
    return []


def novelty(held: dict[str, set], weight: dict, least: int = 1) -> list[tuple[str, int, int]]:
    """Greedy cover: rules by how many holds they explain, ties in order, each kept if it explains enough new ones, with
    both numbers.

    Runs on the driver over a bounded list of grounded rules: ``held`` has the kinds of held case (patterns of violated
    rules) that each rule explains, ``weight`` how many cases are of a kind.
    """
    size = {r: sum(weight[k] for k in kinds) for r, kinds in held.items()}
    seen: set = set()
    out = []
    for rule in sorted(held, key=lambda r: -size[r]):
        fresh = sum(weight[k] for k in held[rule] - seen)
        if fresh >= least:
            out.append((rule, size[rule], fresh))
            seen |= held[rule]
    return out
