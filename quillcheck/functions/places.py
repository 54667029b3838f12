"""Texts in a form that compares, with the way back to the places of the original."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .outcome import _col

_CHANGES = re.compile(r"-[ \t]*\r?\n\s*|\s+|\u2026")
_SAME = str.maketrans("\u2018\u2019\u201c\u201d\u2013\u2014\u03a3", "''\"\"--\u03c3")  # a capital sigma's small form depends on its place
MAPPED = "struct<text: string, at: array<int>, origin: array<int>>"


def mapped_text(text: str) -> tuple[str, list[int], list[int]]:
    """A text with straight quotes and dashes, words broken over lines joined, blanks single, none at the ends, three points for
    an ellipsis, lower case; and its breakpoints: at place ``at[k]`` of it stands place ``origin[k]`` of the original, and
    they run in step up to the next breakpoint."""
    out: list[str] = []
    at, origin, n, last = [0], [0], 0, 0

    def add(piece: str, start: int, end: int) -> None:
        nonlocal n
        out.append(piece)
        if len(piece) != end - start:
            at.extend((n, n + len(piece)))
            origin.extend((start, end))
        n += len(piece)

    for found in _CHANGES.finditer(text):
        start, end = found.span()
        add(text[last:start], last, start)
        whole = found[0]
        ends = start == 0 or end == len(text)
        add("..." if whole == "\u2026" else "" if whole[0] == "-" or ends else " ", start, end)
        last = end
    add(text[last:], last, len(text))
    plain = "".join(out).translate(_SAME)
    low = plain.lower()
    if len(low) != len(plain):  # letters whose small form is longer stay as they are
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in plain)
    return low, at, origin


#: White space as Python's own patterns have it.
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def compared(x: Column | str) -> Column:
    """The text of ``mapped_text`` by built-in functions, but that a dotted capital I is made small: a text that holds another
    in the one form holds it in the other too. For finding what may match, as it costs no Python."""
    text = F.regexp_replace(_col(x), rf"\A{_S}+|-[ \t]*\r?\n{_S}*|{_S}+\z", "")
    text = F.replace(F.regexp_replace(text, f"{_S}+", " "), F.lit("\u2026"), F.lit("..."))
    return F.lower(F.translate(text, "\u2018\u2019\u201c\u201d\u2013\u2014\u03a3", "''\"\"--\u03c3"))


def mapped(x: Column | str) -> Column:
    """``mapped_text`` of a column in Arrow batches: struct(text, at, origin); null for null."""

    @F.pandas_udf(MAPPED)
    def run(xs: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if x is None else mapped_text(x) for x in xs]
        return pd.DataFrame(found, columns=["text", "at", "origin"])

    return run(_col(x))


def original_span(m: Column, start: Column, size: Column) -> Column:
    """struct(start, end) in the original, from 0 and end excluded, of ``size`` characters from place ``start`` of a mapped text.

    What was joined or shrunk right before the span is left out of it, and right after it too; a place inside what stands
    for one character is that character's.
    """
    at, origin = m["at"], m["origin"]
    last = lambda ok: F.size(F.filter(at, ok)) - 1  # noqa: E731  breakpoints rise, so a count is a place
    step = lambda k, place: F.get(origin, k) + place - F.get(at, k)
    begin, end = last(lambda p: p <= start), last(lambda p: p < start + size)
    upto = lambda k, less: F.coalesce(F.get(origin, k + 1) - less, F.lit(2**31 - 1))
    first = F.least(step(begin, start), F.greatest(F.get(origin, begin), upto(begin, 1)))
    after = F.when(size == 0, first).otherwise(F.least(step(end, start + size), upto(end, 0)))
    return F.struct(first.alias("start"), after.alias("end"))
