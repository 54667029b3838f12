"""Rules as data, evaluated to a long table of claims, and what verdicts follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import FAIL, OPEN, PASS, band, compare, outcome, round4, worst


@dataclass(frozen=True)
class Check:
    """One rule over a row. Sides and conditions are SQL expressions of its columns.

    ``applies`` is three-valued: false gives no claim, unknown an open one. ``unless_all`` names columns without which
    the claim stays open, ``open_if`` conditions under which it does; a condition that is unknown leaves it open too.
    ``forms`` replaces ``right`` by the first form whose columns are all there. ``fail_if_null`` fails instead of
    leaving open where one of these columns is missing. ``exact`` rounds the difference to nine places first.
    """

    rule: str
    op: str
    left: str
    right: str | None = None
    tol: float = 0.01
    applies: str | None = None
    unless_all: tuple[str, ...] = ()
    open_if: tuple[str, ...] = ()
    forms: tuple[tuple[tuple[str, ...], str], ...] = ()
    fail_if_null: tuple[str, ...] = ()
    relative: tuple[float, float] | None = None
    exact: bool = False
    advisory: bool = False

    def right_side(self) -> Column:
        if not self.forms:
            return F.lit(None).cast("double") if self.right is None else F.expr(self.right)
        return F.coalesce(*[F.when(_all_present(needs), F.expr(text)) for needs, text in self.forms])

    def claim(self) -> Column:
        """struct(rule, outcome, asserted, expected, variance, reason, advisory), or null where the rule does not apply."""
        numeric = self.op in ("<=", ">=", "=", "!=", "<", ">")
        left, right = F.expr(self.left), self.right_side()
        difference = left - right if numeric else F.lit(None).cast("double")
        tol: Column | float = self.tol
        if numeric and (self.exact or self.relative):
            difference = F.round(difference, 9) if self.exact else difference
            if self.relative:
                tol = band(self.tol, *self.relative, right)
            limit = F.lit(tol) if isinstance(tol, (int, float)) else tol
            held = {
                "<=": difference <= limit, ">=": difference >= -limit, "=": F.abs(difference) <= limit,
                "!=": F.abs(difference) > limit, "<": difference < 0, ">": difference > 0,
            }[self.op]
        else:
            held = compare(self.op, left, right if self.right is not None or self.forms else None, self.tol)
        applies = F.expr(self.applies) if self.applies else F.lit(True)
        steps = [(applies.isNull(), OPEN, "applicability unknown")]
        if self.fail_if_null:
            steps.append((~_all_present(self.fail_if_null), FAIL, "unreadable operand"))
        if self.unless_all:
            steps.append((~_all_present(self.unless_all), OPEN, "guard: operand absent"))
        for text in self.open_if:
            steps.append((F.coalesce(F.expr(text), F.lit(True)), OPEN, "guard"))
        result, reason = outcome(held), F.when(held.isNull(), "operand missing")
        for when, what, why in reversed(steps):
            result, reason = F.when(when, what).otherwise(result), F.when(when, why).otherwise(reason)
        number = lambda x: round4(x) if numeric else F.lit(None).cast("double")
        made = F.struct(
            F.lit(self.rule).alias("rule"), result.alias("outcome"), number(left).alias("asserted"), number(right).alias("expected"),
            F.when(result == FAIL, number(difference)).alias("variance"), reason.alias("reason"), F.lit(self.advisory).alias("advisory"),
        )
        return F.when(applies.isNull() | applies, made)


def _all_present(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.expr(name).isNotNull()
    return out


def run_checks(rows: DataFrame, keys: list[str], checks: list[Check]) -> DataFrame:
    """One claim per row and applicable check: the keys and the claim's columns. One pass over the rows."""
    claims = F.array_compact(F.array(*[c.claim() for c in checks]))
    return rows.select(*keys, F.inline(claims))


def widen(claims: DataFrame, absolute: float, relative: float, cap: float) -> DataFrame:
    """Claims that fail within a tolerance band pass instead, with the reason told."""
    inside = (F.col("outcome") == FAIL) & (F.abs("variance") <= band(absolute, relative, cap, F.col("expected")))
    return claims.withColumns(
        {"reason": F.when(inside, "within tolerance").otherwise(F.col("reason")), "outcome": F.when(inside, PASS).otherwise(F.col("outcome"))}
    )


def verdicts(claims: DataFrame, keys: list[str], consistency: tuple[str, ...] = ()) -> DataFrame:
    """Per key: claims, passes, fails and open ones, the outcome (fail over pass over open) and the gate.

    Advisory claims never count. Rules in ``consistency`` alone cannot make a pass. The gate is PASS-WITH-OPEN where
    an open claim stands beside passes.
    """
    o = F.when(F.col("advisory"), None).otherwise(F.col("outcome"))
    solid = F.when(F.col("rule").isin(*consistency) & (o == PASS), OPEN).otherwise(o) if consistency else o
    out = claims.groupBy(*keys).agg(
        F.count(o).alias("n_total"), F.count_if(o == PASS).alias("n_pass"), F.count_if(o == FAIL).alias("n_fail"),
        F.count_if(o == OPEN).alias("n_open"), worst(solid).alias("outcome"),
    )
    gate = F.when((F.col("outcome") == PASS) & (F.col("n_open") > 0), "PASS-WITH-OPEN").otherwise(F.col("outcome"))
    return out.withColumn("gate", gate)


def omissions(rows: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """One row per missing required role."""
    lost = F.array_compact(F.array(*[F.when(F.col(r).isNull(), F.lit(r)) for r in roles]))
    return rows.select(key, F.explode(lost).alias("role"))


def confusion(rows: DataFrame, keys: list[str], outcome_col: str, positive: Column) -> DataFrame:
    """Outcomes against the truth: counts of hits, rejections, false alarms, misses and abstentions, and rates."""
    o = F.col(outcome_col)
    counts = rows.groupBy(*keys).agg(
        F.count_if((o == FAIL) & positive).alias("tp"), F.count_if((o == PASS) & ~positive).alias("tn"),
        F.count_if((o == FAIL) & ~positive).alias("fp"), F.count_if((o == PASS) & positive).alias("fn"),
        F.count_if(o == OPEN).alias("abstained"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return counts.withColumns(
        {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, tp + tn + fp + fn),
         "false_alarm_rate": share(fp, fp + tn), "coverage": share(tp + tn + fp + fn, tp + tn + fp + fn + F.col("abstained"))}
    )
