"""Candidate rules that a schema of cases allows, what each does on labelled cases, and which of them explain holds.

A case is a row of fields and any number of lines. A candidate is two SQL expressions and a comparison, so that a rule
found here is a ``Check`` as it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import compare, whole
from ..session import cut
from . import mine
from .claims import Check

#: Fixed values, to agree with other implementations: slack by kind of number, tolerances tried, and the judges' limits.
SLACK = {"qty": 1e-9, "money": 0.005}
GRID = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)
LEAST_HOLDS, MOST_CHANCE, LEAST_NEW = 5, 0.01, 3


@dataclass(frozen=True)
class Field:
    """A column of cases or lines. Kinds: qty, money, bool, id, ids (an array). Money has a role: price or amount on
    lines, total or extra on cases. ``source`` names the paper that it stands on."""

    kind: str
    role: str = ""
    source: str = ""
    slack: float | None = None

    @property
    def eps(self) -> float:
        return SLACK[self.kind] if self.slack is None else self.slack


@dataclass(frozen=True)
class Candidate:
    """``left op right`` within ``tol``; ``{t}`` in ``right`` stands for a tolerance of the grid."""

    rule: str
    family: str
    op: str
    left: str
    right: str
    tol: float = 0.0
    per_line: bool = False
    grid: tuple[float, ...] = (0.0,)

    def violated(self, t: float = 0.0) -> Column:
        """True, false, or null where an operand is missing."""
        return ~compare(self.op, F.expr(self.left), F.expr(self.right.format(t=t)), self.tol)

    def check(self, t: float = 0.0) -> Check:
        """The rule as a check of a ruleset, over lines or over cases."""
        return Check(self.rule, self.op, self.left, self.right.format(t=t), tol=self.tol)


@dataclass(frozen=True)
class Term:
    """Something a rule can speak of: a number of a line, a field of a case, or the sum that a source's lines come to."""

    name: str
    sql: str
    scope: str
    field: Field
    at: int = 0  # its place in the schema

    def fits(self, scope: str, kinds: str) -> bool:
        return self.scope == scope and (kinds == "any" or bool({self.field.kind, self.field.role} & set(kinds.split("/"))))


@dataclass(frozen=True)
class Template:
    """A family's form. ``slots`` says what may stand for each letter, as scope and kinds or roles; ``when``, a function of
    the chosen terms, which choices make sense. The slack is the widest of the terms in ``slack``."""

    family: str
    name: str
    op: str
    left: str
    right: str
    slots: dict[str, tuple[str, str]]
    slack: str
    when: Callable[..., bool] = lambda **_: True
    tolerant: bool = False


_GATE = "case when {e} is not null then if(%s{b}, {e}, if({b} is null, null, 0)) end"
_ID = "nullif(upper(regexp_replace({%s}, '\\\\s+', '')), '')"
_CITED = "array_distinct(filter(transform({x}, v -> nullif(upper(regexp_replace(v, '\\\\s+', '')), '')), v -> v is not null))"
_ONE_CITED = f"if(exists({{x}}, v -> v is null), null, slice({_CITED}, 1, if(size({_CITED}) = 1, 1, 0)))"


def _unit(x: Term, y: Term) -> bool:
    return x != y and (x.field.kind, x.field.role) == (y.field.kind, y.field.role)


def _ordered(x: Term, y: Term) -> bool:
    return _unit(x, y) and x.at < y.at


def _same_paper(*terms: Term) -> bool:
    return len({t.field.source for t in terms}) == 1


_TWO = {"x": ("line", "qty/money"), "y": ("line", "qty/money")}
_TOTAL = {"n": ("case", "total"), "s": ("sum", "any")}
#: L1 to L4 compare numbers of a line, D what lines and fields come to, I1 and I2 identifiers.
TEMPLATES = (
    Template("L1", "{x} <= {y}", "<=", "{x}", "{y}", _TWO, "xy", _unit),
    Template("L2", "{x} = {y}", "=", "{x}", "{y}", _TWO, "xy", _ordered),
    Template("L3", "{x} <= {y}*(1+t)", "<=", "{x}", "{y} * (1 + {{t}})", _TWO, "xy", _unit, tolerant=True),
    Template("L4", "{a} = {q}*{p}", "=", "{a}", "{q} * {p}", {"a": ("line", "amount"), "q": ("line", "qty"), "p": ("line", "price")}, "a", lambda a, q, p: _same_paper(a, q, p)),
    Template("D", "{n} = {s}", "=", "{n}", "{s}", _TOTAL, "n", lambda n, s: True),
    Template("D", "{n} <= {s}", "<=", "{n}", "{s}", _TOTAL, "n", lambda n, s: not _same_paper(n, s)),
    Template("D", "{n} = {s} + {e}", "=", "{n}", "{s} + {e}", _TOTAL | {"e": ("case", "extra")}, "n", lambda n, s, e: _same_paper(n, s)),
    Template("D", "{n} = {s} + {e}*[{b}]", "=", "{n}", "{s} + " + _GATE % "", _TOTAL | {"e": ("case", "extra"), "b": ("case", "bool")}, "n", lambda n, s, e, b: _same_paper(n, s)),
    Template("D", "{e} <= 0", "<=", "{e}", "0", {"e": ("case", "extra")}, "e"),
    Template("D", "{e}*[not {b}] <= 0", "<=", _GATE % "not ", "0", {"e": ("case", "extra"), "b": ("case", "bool")}, "e"),
    Template("D", "{s} <= {o}", "<=", "{s}", "{o}", _TOTAL | {"o": ("sum", "any")}, "n", lambda n, s, o: _same_paper(n, s) and not _same_paper(s, o)),
    Template("I1", "{x} cites exactly one id = {y}", "IN", _ID % "y", _ONE_CITED, {"x": ("case", "ids"), "y": ("case", "id")}, ""),
    Template("I2", "{x} = {y}", "IN", _ID % "x", f"array({_ID % 'y'})", {"x": ("case", "id"), "y": ("case", "id")}, "", lambda x, y: x.at < y.at),
)


def sums(lines: dict[str, Field]) -> list[Term]:
    """What each source's lines are worth: sums of its amounts if it has any, else of its quantities times its prices."""
    worth = Template("", "sum({a})", "", "{a}", "", {"a": ("line", "amount")}, "a"), Template(
        "", "sum({q}*{p})", "", "{q} * {p}", "", {"q": ("line", "qty"), "p": ("line", "price")}, "p", lambda q, p: _same_paper(q, p)
    )
    terms = [Term(n, n, "line", f) for n, f in lines.items()]
    found: list[Term] = []
    for form in worth:
        known = {t.field.source for t in found}
        for chosen in _choices(form, terms):
            first = next(iter(chosen.values()))
            if first.field.source not in known:
                found.append(Term(_filled(form.name, chosen, "name"), _filled(form.left, chosen, "sql"), "sum", first.field))
    return found


def _choices(form: Template, terms: list[Term]) -> Iterator[dict[str, Term]]:
    """Every way to fill the slots."""
    fitting = [[t for t in terms if t.fits(*what)] for what in form.slots.values()]
    for chosen in product(*fitting):
        named = dict(zip(form.slots, chosen))
        if form.when(**named):
            yield named


def _filled(text: str, chosen: dict[str, Term], what: str) -> str:
    return text.format(**{letter: getattr(term, what) for letter, term in chosen.items()})


def candidates(
    lines: dict[str, Field], fields: dict[str, Field], grid: tuple[float, ...] = GRID, cuts: Iterable[tuple[str, str, float]] = ()
) -> list[Candidate]:
    """Every rule that the templates make of the schema, template by template, and C: fields with learned constants
    (``cuts``: field, <= or >=, constant). A rule that several choices lead to counts once, with the widest slack."""
    terms = [Term(n, n, scope, f, k) for scope, own in (("line", lines), ("case", fields)) for k, (n, f) in enumerate(own.items())]
    terms += [Term(t.name, f"`{t.name}`", "sum", t.field) for t in sums(lines)]
    out: dict[str, Candidate] = {}
    for form in TEMPLATES:
        for chosen in _choices(form, terms):
            rule = f"{form.family} {_filled(form.name, chosen, 'name')}"
            eps = max([chosen[letter].field.eps for letter in form.slack], default=0.0)
            known = out[rule].tol if rule in out else 0.0
            per_line = all(t.scope == "line" for t in chosen.values())
            out[rule] = Candidate(rule, form.family, form.op, _filled(form.left, chosen, "sql"), _filled(form.right, chosen, "sql"), max(eps, known), per_line, grid if form.tolerant else (0.0,))
    made = [Candidate(f"C {n} {op} c", "C", op, n, repr(c)) for n, op, c in cuts if fields[n].kind in SLACK]
    return [*out.values(), *made]


_WORD = 62  # bits of a long that are used


def _marks(violated: list[Column], name: str) -> list[Column]:
    """Which are true and which are not known, as bits of as few longs as hold them."""
    out = []
    for k in range(0, len(violated), _WORD):
        for kind, when in (("bad", lambda v: v), ("lost", lambda v: v.isNull())):
            bits = [F.when(when(v), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n, v in enumerate(violated[k : k + _WORD])]
            out.append(reduce(Column.bitwiseOR, bits).alias(f"_{name}_{kind}{k // _WORD}"))
    return out


def _sign(name: str, at: int) -> Column:
    bad, lost = (F.col(f"_{name}_{kind}{at // _WORD}").bitwiseAND(F.lit(1 << at % _WORD).cast("long")) for kind in ("bad", "lost"))
    return F.when(bad != 0, "1").when(lost == 0, "0").otherwise("?")


def flags(docs: DataFrame, lines: DataFrame, key: str, held: Column, found: list[Candidate], of_lines: dict[str, Field]) -> DataFrame:
    """One row a case: the key, ``held``, and ``flags``: per candidate and tolerance 1 (violated), 0 or ? (not told).

    Lines are put together once for all candidates, by one exchange; a line rule is violated if any line violates it, and
    not told if some line cannot tell. A sum is missing if any of its lines is. What a line, or a case by itself, says of
    its rules travels as bits, so an exchanged row is as short for many rules as for few.
    """
    tried = [(c, t) for c in found for t in c.grid]
    worth = {t.name: t.sql for t in sums(of_lines)}
    kinds = ["line" if c.per_line else "sum" if any(f"`{n}`" in c.left + c.right for n in worth) else "case" for c, _ in tried]
    violated = lambda kind: [c.violated(t) for (c, t), k in zip(tried, kinds) if k == kind]
    made = _marks(violated("line"), "line")
    lines = lines.select("*", *made)
    ored = [F.bit_or(c).alias(c) for c in lines.columns[len(lines.columns) - len(made) :]]
    totals = [whole(F.sum(F.expr(sql).cast("decimal(28,6)")), F.expr(sql)).cast("double").alias(name) for name, sql in worth.items()]
    summed = lines.groupBy(key).agg(*ored, *totals) if ored or totals else lines.select(key).distinct()
    rows = docs.select("*", held.alias("_held"), *_marks(violated("case"), "case")).join(summed, key, "left")
    signs = []
    for n, (c, t) in enumerate(tried):
        v = c.violated(t)
        signs.append(F.when(v, "1").when(~v, "0").otherwise("?") if kinds[n] == "sum" else _sign(kinds[n], kinds[:n].count(kinds[n])))
    return rows.select(key, F.col("_held").alias("held"), F.concat(*signs).alias("flags"))


def patterns(flagged: DataFrame) -> DataFrame:
    """Cases counted by what they violate: rules are few, so these are far fewer than cases."""
    return flagged.groupBy("held", "flags").agg(F.count("*").alias("cases"))


def tallies(counted: DataFrame, found: list[Candidate]) -> DataFrame:
    """Per candidate and tolerance: cases that tell, holds among them, violators, holds and approvals among those."""
    tried = [(c.rule, c.family, t) for c in found for t in c.grid]
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(f).alias("family"), F.lit(t).alias("t")) for r, f, t in tried])
    none = counted.sparkSession.range(1).select(F.lit(False).alias("held"), F.lit("?" * len(tried)).alias("flags"), F.lit(0).cast("long").alias("cases"))
    counted = counted.unionByName(none)  # so that rules have a row without any case
    place = F.explode(F.sequence(F.lit(0), F.lit(len(tried) - 1))).alias("at")
    rows = counted.select("held", "cases", "flags", place).select("held", "cases", "at", F.expr("substr(flags, at + 1, 1)").alias("sign"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("cases"))), F.lit(0))
    told, violated, held = F.col("sign") != "?", F.col("sign") == "1", F.col("held")
    by_rule = rows.groupBy("at").agg(
        count(told).alias("n"), count(told & held).alias("holds"), count(violated).alias("k"), count(violated & held).alias("k_holds"), count(violated & ~held).alias("k_approved")
    )
    return by_rule.select(F.get(names, F.col("at")).alias("c"), "*").select("c.*", "n", "holds", "k", "k_holds", "k_approved")


def report(counted: DataFrame, found: list[Candidate], rate: float = 0.0) -> DataFrame:
    """Each candidate's fate. INCONSISTENT: at no tolerance do few enough approved cases (a share ``rate``) violate it; the
    smallest that will do is taken. VOID: no case violates it. BASE_RATE: too few holds do, or chance explains them.
    Of the rest a CANDLE explains holds that no stronger rule does; the others are REDUNDANT.

    Tallies come to the driver, a row a rule and tolerance; patterns of cases do not. Cases are read once: what is counted
    is stored, as the tallies and the judges' rounds both read it.
    """
    counted = cut(counted)
    tally = {(r.rule, r.t): r for r in tallies(counted, found).collect()}
    place = {key: n for n, key in enumerate((c.rule, t) for c in found for t in c.grid)}
    out, explained = [], []
    for c in found:
        fits = lambda r: r.k_approved <= int(rate * (r.n - r.holds) + 1e-9)
        t = next((t for t in c.grid if fits(tally[c.rule, t])), None)
        r = tally[c.rule, c.grid[-1] if t is None else t]
        chance = mine.upper_tail(r.n, r.holds, r.k, r.k_holds) if r.k and t is not None else 1.0
        fate = "INCONSISTENT" if t is None else "VOID" if not r.k else "BASE_RATE" if r.k_holds < LEAST_HOLDS or chance > MOST_CHANCE else "REDUNDANT"
        if fate == "REDUNDANT":
            explained.append((c.rule, place[c.rule, t]))
        out.append([c.rule, c.family, t, r.n, r.holds, r.k, r.k_holds, r.k_approved, float(f"{chance:.12g}"), fate])
    new = {rule for rule, _, _ in mine.cover(counted.where("held"), explained, LEAST_NEW)}
    for row in out:
        row[-1] = "CANDLE" if row[0] in new else row[-1]
    schema = "rule string, family string, t double, n long, holds long, k long, k_holds long, k_approved long, chance double, fate string"
    return counted.sparkSession.createDataFrame([tuple(row) for row in out], schema)
