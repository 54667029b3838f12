"""Two sides of the books against one another: census by key, cross-document checks and three-way matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import FAIL, OPEN, PASS

MATCHED, BYPASSED, ORPHAN, AMBIGUOUS = "MATCHED", "BYPASSED", "ORPHAN", "AMBIGUOUS"
MISMATCHED, LATE, HELD = "MISMATCHED", "CHECKED_AFTER_PAYMENT", "PAID_DESPITE_HOLD"


def completeness(payments: DataFrame, book: DataFrame, amount_tol: float = 0.01, days: int = 0) -> DataFrame:
    """One class per key and one row per unkeyed payment or record.

    ``payments`` has key, amount, currency, paid_at; ``book`` has key, amount, currency, decided_at, outcome. Both sides
    are grouped by key first, so the full outer join is one to one whatever repeats: a key without records is BYPASSED,
    one without payments ORPHAN, a pair is compared, anything else is AMBIGUOUS. A null key never joins. A pair's class is
    the first that holds of paid despite a hold, mismatched, decided after payment, matched; what either side lacks is
    not compared.
    """
    one = lambda c, name: F.min(c).alias(name)  # noqa: E731  of a group of one
    left = payments.where("key is not null").groupBy("key").agg(
        F.count("*").alias("n_payments"), F.sum("amount").alias("paid"), one("currency", "paid_currency"), one("paid_at", "paid_at")
    )
    right = book.where("key is not null").groupBy("key").agg(
        F.count("*").alias("n_records"), F.sum("amount").alias("booked"), one("currency", "booked_currency"), one("decided_at", "decided_at"), one("outcome", "outcome")
    )
    both = left.join(right, "key", "full_outer").fillna(0, ["n_payments", "n_records"])
    differs = F.coalesce(F.abs(F.col("paid") - F.col("booked")) > amount_tol, F.lit(False)) | F.coalesce(
        F.col("paid_currency") != F.col("booked_currency"), F.lit(False)
    )
    late = F.coalesce(F.datediff("decided_at", "paid_at") > days, F.lit(False))
    kind = (
        F.when(F.col("n_records") == 0, BYPASSED).when(F.col("n_payments") == 0, ORPHAN)
        .when((F.col("n_payments") > 1) | (F.col("n_records") > 1), AMBIGUOUS)
        .when(F.col("outcome") == FAIL, HELD).when(differs, MISMATCHED).when(late, LATE).otherwise(MATCHED)
    )
    shape = F.when(F.col("n_payments") == 1, "one payment, several records").when(F.col("n_records") == 1, "several payments, one record").otherwise("several of both")
    reason = F.when(kind == AMBIGUOUS, shape)
    keyed = both.select("key", kind.alias("class"), reason.alias("reason"), "n_payments", "n_records", "paid", "booked", F.coalesce("paid_currency", "booked_currency").alias("currency"))
    lone = lambda df, what, why, n, m: df.where("key is null").select(
        F.col("key"), F.lit(what).alias("class"), F.lit(why).alias("reason"), F.lit(n).cast("long").alias("n_payments"), F.lit(m).cast("long").alias("n_records"),
        (F.col("amount") if n else F.lit(None)).cast(keyed.schema["paid"].dataType).alias("paid"),
        (F.col("amount") if m else F.lit(None)).cast(keyed.schema["booked"].dataType).alias("booked"), "currency",
    )
    return keyed.unionByName(lone(payments, BYPASSED, "NO_KEY", 1, 0)).unionByName(lone(book, ORPHAN, "UNKEYED", 0, 1))


def coherence(left: DataFrame, right: DataFrame, on: Column, checks: dict[str, tuple[str, str, float, float]]) -> DataFrame:
    """The left documents' columns with one outcome per check (left side, right side, absolute, relative): open where
    the right document or a value is missing. The two tolerances widen one another, unlike a capped band."""
    rows = left.join(right, on, "left")
    for name, (a, b, absolute, relative) in checks.items():
        x, y = F.expr(a), F.expr(b)
        tol = F.greatest(F.lit(absolute), relative * F.greatest(F.abs(x), F.abs(y)))
        held = F.abs(x - y) <= tol
        rows = rows.withColumn(name, F.when(held, PASS).when(~held, FAIL).otherwise(OPEN))
    return rows


def first_failing(claims: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """The decision per key: that of the first claim in policy order that does not pass; an open one asks instead.

    ``claims`` has the keys, rule and outcome; ``policy`` gives each rule's decision in order.
    """
    places = F.create_map(*[F.lit(x) for k, rule in enumerate(policy) for x in (rule, k)])
    decisions = F.create_map(*[F.lit(x) for pair in policy.items() for x in pair])
    place = F.element_at(places, F.col("rule"))
    bad = F.when(F.col("outcome") != PASS, F.struct(place.alias("place"), "rule", "outcome"))
    out = claims.where(place.isNotNull()).groupBy(*keys).agg(F.min(bad).alias("_first"))
    decision = F.when(F.col("_first").isNull(), "APPROVE").when(F.col("_first.outcome") == OPEN, "ASK").otherwise(F.element_at(decisions, F.col("_first.rule")))
    return out.select(*keys, decision.alias("decision"), F.col("_first.rule").alias("because"))


def agree(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two readings of the same fields: the value where both agree, else what stands in the way."""
    rows = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    status = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "NOT_PRINTED").when(F.col("_a").isNull() | F.col("_b").isNull(), "ONE_READER").when(
        F.col("_a") == F.col("_b"), "AGREED"
    ).otherwise("UNREADABLE")
    return rows.select(*keys, F.when(status == "AGREED", F.col("_a")).alias(value), status.alias("status"))
