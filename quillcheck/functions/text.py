"""Identifiers, names and quotations in forms that compare equal when they mean the same."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .outcome import _col, words

#: Words for a company's legal form that do not tell companies apart (fixed values, to agree with other implementations).
COMPANY_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "co", "company", "corp", "corporation", "gmbh", "sa", "plc", "llp", "lp")


@lru_cache
def _compatible() -> tuple[str, str]:
    """Characters that Unicode takes for variants of one other character (NFKC), and those others."""
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    return tuple("".join(x) for x in zip(*((a, b) for a, b in pairs if a != b and len(b) == 1)))


def plain_width(x: Column | str) -> Column:
    """Variants of characters (full width, mathematical, super- and subscript, non-breaking blanks) as the plain one. Texts in
    ASCII are not touched; characters that stand for several, but for ligatures, and letters with separate marks stay."""
    x = _col(x)
    text = F.translate(x, *_compatible())
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    return F.when(x.rlike(r"[^\x00-\x7F]"), text).otherwise(x)


def folded(x: Column | str) -> Column:
    """Upper case without blanks or invisible characters, variants of characters as the plain one."""
    return F.upper(F.regexp_replace(plain_width(x), r"[\p{Cf}\p{Zs}\s]", ""))


def tight_id(x: Column | str) -> Column:
    """Runs of letters and digits in upper case, zeros before numbers off, joined by bars."""
    parts = F.filter(F.split(F.upper(_col(x)), "[^A-Z0-9]+"), lambda s: s != "")
    split = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Z])", "|"), r"(^|\|)0+(?=[0-9])", "$1"))
    return F.array_join(split, "|")


def base_id(x: Column | str) -> Column:
    """A tight identifier without a revision at its end (R2, REV 3, V1, a single letter)."""
    return F.regexp_replace(tight_id(x), r"\|(REV|R|V|VER|COPY)(\|[0-9]+)?$|\|[A-Z]$", "")


def identifier_key(x: Column | str) -> Column:
    """A folded identifier without punctuation but for one dash between digits."""
    kept = F.regexp_replace(folded(x), r"(?<=[0-9])\p{P}+(?=[0-9])", "\u0001")
    return F.translate(F.regexp_replace(kept, r"\p{P}", ""), "\u0001", "-")


def spoken(x: Column | str) -> Column:
    """A name's words in lower case, variants of characters as the plain one: "&" is "and", points, commas and apostrophes go,
    other signs part words. Letters of any script stay."""
    joined = F.replace(F.lower(plain_width(x)), F.lit("&"), F.lit(" and "))
    for sign in ".,'’":
        joined = F.replace(joined, F.lit(sign), F.lit(""))
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " "))


#: Such words at the end of a name as spoken, while a word remains.
LEGAL_FORMS = rf"(?<=[^ ])( ({'|'.join(COMPANY_SUFFIXES)}))+$"


def vendor_name(x: Column | str) -> Column:
    """A name as spoken, without the words for its legal form at the end while a word remains."""
    return F.regexp_replace(spoken(x), LEGAL_FORMS, "")


def document_number(x: Column | str) -> Column:
    """Letters and digits in upper case, without zeros at the front."""
    return F.regexp_replace(F.regexp_replace(F.upper(_col(x)), "[^A-Z0-9]", ""), "^0+(?=.)", "")


def allowed_edits(n: Column) -> Column:
    """Edits that still count as the same name, by its length (fixed values: none under 6, 1 under 16, 2 under 32, else 3)."""
    return F.when(n < 6, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3)


def deletions(x: str, most: Column) -> Column:
    """Hashes of a text after deleting up to ``most`` (at most 3) of its characters, each once."""
    part = lambda i, j: f"substr({x}, {i} + 1, {j} - {i} - 1)"  # noqa: E731  what stands between places i and j
    n, h = f"length({x})", "xxhash64"
    one = f"transform(sequence(1, {n}), i -> {h}(concat({part('0', 'i')}, substr({x}, i + 1))))"
    two = f"flatten(transform(sequence(1, {n} - 1), i -> transform(sequence(i + 1, {n}), j -> {h}(concat({part('0', 'i')}, {part('i', 'j')}, substr({x}, j + 1))))))"
    three = (
        f"flatten(flatten(transform(sequence(1, {n} - 2), i -> transform(sequence(i + 1, {n} - 1), j -> transform(sequence(j + 1, {n}), "
        f"k -> {h}(concat({part('0', 'i')}, {part('i', 'j')}, {part('j', 'k')}, substr({x}, k + 1))))))))"
    )
    levels = [F.when(most >= k, F.expr(e)).otherwise(F.array().cast("array<bigint>")) for k, e in ((1, one), (2, two), (3, three))]
    return F.array_distinct(F.concat(F.array(F.xxhash64(x)), *levels))


def edit_distance(x: str, y: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours (each place edited once) that turn x into y."""
    before, last = [], list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row = [i]
        for j, d in enumerate(y, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d))
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


#: The length of texts that are compared together.
TOGETHER = 40


def _distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """``edit_distance`` of many pairs at once: the cells of all their tables are worked out together."""
    n, wide, high = len(xs), max(map(len, xs), default=0), max(map(len, ys), default=0)
    points = lambda texts, most: np.array([[*map(ord, t), *[-1] * (most - len(t))] for t in texts], np.int32).reshape(n, most).T
    a, b = points(xs, wide), points(ys, high)
    last_x, last_y = (np.array([len(t) for t in texts]) for texts in (xs, ys))
    out = np.where(last_x == 0, last_y, 0)
    before, last = [], [np.full(n, j, np.int32) for j in range(high + 1)]
    for i in range(1, wide + 1):
        row = [np.full(n, i, np.int32)]
        for j in range(1, high + 1):
            cost = np.minimum(np.minimum(last[j], row[-1]) + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1:
                swap = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                cost = np.where(swap, np.minimum(cost, before[j - 2] + 1), cost)
            row.append(cost)
        ends = last_x == i
        if ends.any():
            out = np.where(ends, np.stack(row)[last_y, np.arange(n)], out)
        before, last = last, row
    return out


def _core(x: str, y: str) -> tuple[str, str]:
    """Two texts without the beginning and the end that they share, which cost no edits."""
    head = len(os.path.commonprefix((x, y)))
    x, y = x[head:], y[head:]
    tail = len(os.path.commonprefix((x[::-1], y[::-1])))
    return (x[: len(x) - tail], y[: len(y) - tail]) if tail else (x, y)


def many_edits(xs, ys) -> list[int | None]:
    """``edit_distance`` of many pairs; null if either is. What both share at their ends is cut off; each distinct rest is compared
    once, short ones together."""
    cores = [None if a is None or b is None else _core(a, b) for a, b in zip(xs, ys)]
    distinct = sorted({c for c in cores if c}, key=lambda c: len(c[0]) + len(c[1]))
    short = [c for c in distinct if max(map(len, c)) <= TOGETHER]
    known = {c: edit_distance(*c) for c in distinct if max(map(len, c)) > TOGETHER}
    for some in batched(short, 4096):
        known |= zip(some, map(int, _distances([a for a, _ in some], [b for _, b in some])))
    return [None if c is None else known[c] for c in cores]


def edits(x: str, y: str) -> Column:
    """``edit_distance`` of two columns in Arrow batches; Spark's own distance does not know swaps. Null if either is."""

    @F.pandas_udf("int")
    def distance(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(many_edits(xs, ys), dtype="Int32")

    return distance(x, y)


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared words over the smaller set of words; 0 if either has none."""
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).when(least == 0, 0.0)


#: Runs of blanks but for one that is a single blank already, as most are: what stands so is not written anew.
SPACES = r"[\t\n\x0B\f\r]\s*| \s+"


def quotable(x: Column | str) -> Column:
    """Text for quotation matching: straight quotes and dashes, words broken over lines joined, blanks single, lower case."""
    text = F.replace(_col(x), F.lit("-\n"), F.lit(""))
    for one, plain in {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}.items():
        text = F.replace(text, F.lit(one), F.lit(plain))
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def words_in_order(a: Column, b: Column) -> Column:
    """How many words two arrays share in order (the longest common subsequence): a table's rows, one after another, in built-in
    functions. Work is words by words, so this is for names; null for a null array."""

    def row(last: Column, x: Column) -> Column:
        best = lambda new, j: F.when(F.get(b, j - 1) == x, F.get(last, j - 1) + 1).otherwise(F.greatest(F.get(last, j), F.get(new, j - 1)))
        return F.reduce(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), lambda new, j: F.concat(new, F.array(best(new, j))))

    some = (F.size(a) > 0) & (F.size(b) > 0)
    found = F.element_at(F.reduce(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)
    return F.when(some, found).when(a.isNotNull() & b.isNotNull(), 0)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


_BLANKS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def spaced(x: Column | str) -> Column:
    """Every run of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), _BLANKS, " "))


def description(x: Column | str) -> Column:
    """A description to compare: lower case, only ASCII letters, digits, underscores and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_col(x)), _BLANKS, " "), "[^a-z0-9_ ]", ""), " +", " "))


#: Ligatures and the letters they stand for (fixed values of Unicode).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def canonical(x: Column | str) -> Column:
    """A reading without the marks of its layout: soft hyphens and hyphens at line ends joined, ligatures apart, one kind of
    dash and of each quote, three points for an ellipsis, single blanks. Composed letters are taken as they come."""
    text = F.regexp_replace(_col(x), r"\x{ad}\s*", "")
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    text = F.translate(text, "‐‑‒–—―−‘’‚‛′“”„‟″", "-" * 7 + "'" * 5 + '"' * 5)
    text = F.regexp_replace(text, r"(?<=\p{L})-[ \t]*\r?\n[ \t\r\n]*(?=\p{Ll})", "")
    return spaced(F.replace(text, F.lit("…"), F.lit("...")))


def label_line(x: Column | str, labels: tuple[str, ...]) -> Column:
    """The first line that a label heads, as (line from 1, label, text); null if none.

    Case and runs of blanks do not count. No letter or digit may follow the label at once, and a line that goes on with a
    word in lower case and holds no digit after the label is a heading, not a row. Of labels that head one line the first
    given is taken.
    """
    lines = F.transform(F.split(_col(x), "\r?\n"), lambda l, i: F.struct((i + 1).alias("line"), spaced(l).alias("text")))

    def headed(l: Column, label: str) -> Column:
        rest = F.substring(l, F.lit(len(label) + 1), F.length(l))
        return F.lower(l).startswith(label) & ~rest.rlike(r"^[\p{L}\p{N}]") & ~(F.trim(rest).rlike(r"^\p{Ll}+( |$)") & ~rest.rlike(r"\p{N}"))

    wanted = [" ".join(label.split()).lower() for label in labels]
    name = lambda l: F.coalesce(*[F.when(headed(l, label), label) for label in wanted])
    found = F.transform(lines, lambda r: F.struct(r["line"].alias("line"), name(r["text"]).alias("label"), r["text"].alias("text")))
    return F.get(F.filter(found, lambda r: r["label"].isNotNull()), 0)


def raw_line(x: Column | str, raw: Column) -> Column:
    """The number of the first line that holds a value as reported, blanks collapsed in both; null if none or under two characters."""
    place = F.array_position(F.transform(F.split(_col(x), "\r?\n"), lambda l: F.contains(spaced(l), spaced(raw))), True)
    return F.when(F.length(spaced(raw)) >= 2, F.nullif(place, F.lit(0)))
