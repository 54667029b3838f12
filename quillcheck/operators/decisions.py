"""Gate labels, tax due, bars in money, promotion policies, audits of reviews, and values with quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.outcome import FAIL, OPEN, PASS


def gate_label(verdict: Column, suspects: Column, struck: Column, unknown: Column) -> Column:
    """What a person reads at the gate, from a verdict and its numbers of suspect claims, struck load-bearing fields and
    claims that could not run. A suspect claim or a struck field shows unless the verdict fails by itself."""
    return (
        F.when((verdict != FAIL) & (suspects > 0), "HELD-SUSPECT")
        .when((verdict != FAIL) & (struck > 0), "OPEN")
        .when((verdict == PASS) & (unknown > 0), "PASS-WITH-OPEN")
        .otherwise(verdict)
    )


def tax_due(tax: Column, rate: Column, base: Column, n_lines: Column, unit: float = 0.01) -> Column:
    """(outcome, reason) of a bill's tax against the rate that its order states, over ``base``, the sum of taxed lines.

    Rounding is one minor unit a taxed line, one at least. Tax where the order states none is for a person; tax where the
    order states a rate of zero fails; a null tax makes no claim (null).
    """
    off = F.abs(tax - rate * base) - unit * F.greatest(n_lines, F.lit(1))
    result = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))
    return (
        F.when(tax.isNull(), F.lit(None))
        .when(F.abs(tax) < unit / 2, result(PASS, "no tax billed"))
        .when(tax < 0, result(OPEN, "negative tax"))
        .when(rate.isNull(), result(OPEN, "no tax terms"))
        .when(rate == 0, result(FAIL, "no tax due"))
        .when(off <= 1e-9, result(PASS, "as stated"))
        .otherwise(result(OPEN, "off the stated rate"))
    )


def money_bar(tolerable: Column, flow: Column, ceiling: float = 0.05) -> Column:
    """The error rate at which errors stay within a tolerable amount of a flow, at most ``ceiling``; null unless both are positive."""
    return F.when((tolerable > 0) & (flow > 0), F.least(F.lit(ceiling), tolerable / flow))


def lint_tiers(tiers: DataFrame, policy: str, order: str, confidence: float = 0.95) -> DataFrame:
    """Each tier of each policy (columns ``min_n``, ``max_error``) with what is wrong in it: a burden of proof lighter than the
    tier's below it is an error; a minimum that can never clear its own bar, even with no miss, is a warning."""
    before = Window.partitionBy(policy).orderBy(order)
    rows = tiers.withColumn("below", F.lag(F.struct("min_n", "max_error")).over(before)).withColumn("zero_miss", stats.zero_miss_size(F.col("max_error"), confidence))
    found = F.array_compact(
        F.array(
            F.when(~F.col("max_error").between(1e-12, 1 - 1e-12), "max_error out of range"),
            F.when(F.col("min_n") < F.col("below.min_n"), "min_n falls"),
            F.when(F.col("max_error") > F.col("below.max_error"), "max_error rises"),
            F.when(F.col("min_n") < F.col("zero_miss"), "min_n is inert"),
        )
    )
    return rows.withColumn("findings", F.array_join(found, "; ")).drop("below")


def audit_reviews(reviews: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """Per workflow what its reviews show (columns ``drawn``, ``planted``, ``signed``, ``owner``, ``reviewer``, ``overturned``).

    A review counts if its case was drawn at random, is no planted one, is signed, and is not by the case's own maker; the
    first rule that it breaks sets it aside. Drawn cases without a review are untested. The planted ones, reviewed by
    another than who planted them, give the share caught and its lower bound. Unknown marks count against a review.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = F.coalesce(F.col("owner") == F.col("reviewer"), F.lit(True))
    why = F.when(yes("planted"), "planted").when(~yes("signed"), "unsigned").when(own, "own work").when(~yes("drawn"), "not drawn").otherwise("counted")
    state = F.when(F.col("reviewer").isNull(), F.when(yes("drawn") & ~yes("planted"), "untested")).otherwise(why)
    test = (state == "planted") & yes("signed") & ~own
    sums = reviews.groupBy(*keys).agg(
        *[F.count_if(state == s).alias(f"n_{s.replace(' ', '_')}") for s in ("counted", "not drawn", "own work", "unsigned", "untested")],
        F.count_if((state == "counted") & yes("overturned")).alias("n_overturned"),
        F.count_if(test).alias("n_tests"),
        F.count_if(test & yes("overturned")).alias("n_caught"),
    )
    return sums.withColumn("caught_at_least", F.when(F.col("n_tests") > 0, stats.caught_rate(F.col("n_caught"), F.col("n_tests"), confidence)))


def by_flag(flag: Column, value: Column, policy: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Aggregates over values with quality flags: the policy says which flags compute, hold, strike or mean absent; any other
    flag holds. Values that compute give sum and count; a single held one holds the whole."""
    is_a = lambda what: F.coalesce(flag.isin(*policy.get(what, ())), F.lit(False))
    uses, struck, absent = is_a("compute") & value.isNotNull(), is_a("strike"), is_a("absent") | (is_a("compute") & value.isNull())
    held = ~(is_a("compute") | struck | absent)
    return {
        "n_used": F.count_if(uses),
        "n_held": F.count_if(held),
        "n_struck": F.count_if(struck),
        "n_absent": F.count_if(absent),
        "total": F.when(F.count_if(held) == 0, F.sum(F.when(uses, value))),
    }
