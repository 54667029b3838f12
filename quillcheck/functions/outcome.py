"""Three outcomes instead of two: comparisons, guards and aggregates that say when they cannot tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, OPEN = "PASS", "FAIL", "INSUFFICIENT_DATA"


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def words(text: Column | str) -> Column:
    """Distinct lower-case words of more than two letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(text)), "[^a-z0-9_]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Words in common over all words; 0 if neither has any."""
    both, any_ = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(any_ > 0, both / any_).when(any_ == 0, 0.0)


def compare(op: str, left: Column | str, right: Column | str | float | None = None, tol: float = 0) -> Column:
    """Whether the comparison holds; null where an operand is missing, as that is neither pass nor fail.

    Numbers compare within ``tol`` for <= >= = and !=. IN and NOT_IN look in an array, EMPTY and NOT_EMPTY at one,
    EXISTS and NOT_EXISTS for null, SIMILAR_TO at shared words, with ``tol`` as the least share.
    """
    l, r = _col(left), None if right is None else _col(right)  # noqa: E741
    t = F.lit(tol) if tol else F.lit(0)
    if op in ("<=", ">=", "=", "!="):
        if not tol:
            return {"<=": l <= r, ">=": l >= r, "=": l == r, "!=": l != r}[op]
        return {"<=": l <= r + t, ">=": l >= r - t, "=": F.abs(l - r) <= t, "!=": F.abs(l - r) > t}[op]
    if op in ("<", ">"):
        return l < r if op == "<" else l > r
    if op in ("IN", "NOT_IN"):
        found = F.array_contains(r, l)
        return found if op == "IN" else ~found
    if op in ("EMPTY", "NOT_EMPTY"):
        return (F.size(l) == 0 if op == "EMPTY" else F.size(l) > 0) & F.when(l.isNotNull(), F.lit(True))
    if op in ("EXISTS", "NOT_EXISTS"):
        return l.isNotNull() if op == "EXISTS" else l.isNull()
    if op == "SIMILAR_TO":
        return jaccard(l, r) >= t
    raise ValueError(f"unknown comparison {op}")


def outcome(passed: Column) -> Column:
    return F.when(passed, PASS).when(~passed, FAIL).otherwise(OPEN)


def round4(x: Column | str) -> Column:
    """Four places, halves towards positive infinity."""
    return F.floor(_col(x).cast("double") * 1e4 + 0.5) / 1e4


def whole(value: Column, operand: Column | str) -> Column:
    """An aggregate of ``operand`` if there are rows and all have it, else null."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(_col(operand))), value)


def any_line(v: Column | str) -> Column:
    """Over the lines of a group: true if any is true, null if any is unknown or there is none, else false."""
    v = _col(v)
    return F.when(F.bool_or(v), F.lit(True)).when((F.count(F.lit(1)) == 0) | (F.count_if(v.isNull()) > 0), F.lit(None)).otherwise(F.lit(False))


def worst(outcomes: Column) -> Column:
    """Over the claims of a group: FAIL if any fails, else PASS if any passes, else open."""
    return (
        F.when(F.count_if(outcomes == FAIL) > 0, FAIL).when(F.count_if(outcomes == PASS) > 0, PASS).otherwise(OPEN)
    )


def band(absolute: float, relative: float, cap: float, expected: Column) -> Column:
    """Tolerated variance: an absolute floor, or a share of what is expected up to a cap."""
    return F.greatest(F.lit(absolute), F.least(relative * F.abs(expected), F.lit(cap)))
