"""Numbers as documents write them, and the steps that rounding takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .outcome import _col


def decimal_text(text: Column | str, decimal: str = ".", group: str = ",") -> Column:
    """The amount that a declared format writes: groups of three, brackets or a minus at either end for negative;
    null for anything else."""
    d, g = ("\\" + c if c in ".|()[]" else c for c in (decimal, group))
    raw = F.trim(_col(text))
    bracketed, trailing = raw.rlike(r"^\(.*\)$"), raw.rlike(r"-$")
    bare = F.regexp_replace(raw, r"^\(|\)$|-$|^-", "")
    plain = F.regexp_replace(F.regexp_replace(bare, g, ""), d, ".")
    fits = bare.rlike(rf"^([0-9]{{1,3}}({g}[0-9]{{3}})+|[0-9]+)({d}[0-9]+)?$")
    value = F.when(fits, plain.try_cast("decimal(28,6)"))
    return F.when(bracketed | trailing | raw.startswith("-"), -value).otherwise(value)


def amount(raw: Column | str) -> Column:
    """Amount text to cents: currency signs off, the last of comma and point is the decimal mark if one or two digits
    follow it, brackets mean negative."""
    text = F.regexp_replace(_col(raw), r"[\s$€£¥]|USD|EUR|GBP", "")
    negative = text.rlike(r"^\(.*\)$|^-")
    bare = F.regexp_replace(text, r"^[-(]+|\)$", "")
    european = bare.rlike(r",[0-9]{1,2}$")
    plain = F.when(european, F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", ""))
    value = F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.round(plain.try_cast("decimal(28,6)"), 2))
    return F.when(negative, -value).otherwise(value)


def rate(raw: Column | str) -> Column:
    """A rate as a fraction: a percent sign or a value over 1 means percent."""
    text = F.trim(_col(raw))
    number = F.regexp_replace(text, r"[%\s]", "").try_cast("double")
    return F.when(text.contains("%") | (number > 1), number / 100).otherwise(number)


def quantity(raw: Column | str) -> Column:
    """The leading number of texts such as "3 x", "2.5 hrs" or "12"."""
    return F.nullif(F.regexp_extract(_col(raw), r"^\s*([0-9]+(\.[0-9]+)?)\s*([a-zA-Z]*\.?)\s*$", 1), F.lit("")).try_cast("double")


#: Fixed values of ISO 4217: currencies without a minor unit, and with one of three decimal places.
NO_DECIMALS = ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "UYI", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_DECIMALS = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")


def minor_unit(currency: Column | str) -> Column:
    """The smallest amount of a currency, in any case: of three, no or else two decimal places."""
    code = F.upper(_col(currency))
    unit = F.when(code.isin(*THREE_DECIMALS), 0.001).when(code.isin(*NO_DECIMALS), 1.0).otherwise(0.01)
    return unit.cast("decimal(10,3)")


def reporting_unit(values: Column) -> Column:
    """Over a group: the largest of a million, a hundred thousand and a thousand that divides every value, else 1."""
    out = F.lit(1)
    for unit in (1_000, 100_000, 1_000_000):
        out = F.when(F.bool_and(values % unit == 0), unit).otherwise(out)
    return out


def cash_step(value: Column, grain: Column) -> Column:
    """The largest of 100, 50, 10 and 5 grains that divides the value, else the grain."""
    cents, unit = F.round(value * 100).cast("long"), F.round(grain * 100).cast("long")
    out = grain
    for k in (5, 10, 50, 100):
        out = F.when(cents % (unit * k) == 0, grain * k).otherwise(out)
    return out


def surface_forms(x: Column) -> Column:
    """Ways to write a number: plain and grouped, with and without two places."""
    cents = x.cast("decimal(28,2)")
    plain = F.regexp_replace(cents.cast("string"), r"\.00$", "")
    grouped = F.format_number(cents, 2)
    return F.array_distinct(F.array(plain, cents.cast("string"), F.regexp_replace(grouped, r"\.00$", ""), grouped))


def trimmed(x: Column) -> Column:
    """Decimal text without zeros at the end."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


#: First code points of runs of ten decimal digits that stand for 0 to 9 (fixed values): full width, Arabic-Indic, its
#: extended form, Devanagari, Bengali, Thai.
DIGIT_RUNS = {"full width": 0xFF10, "arabic": 0x0660, "persian": 0x06F0, "devanagari": 0x0966, "bengali": 0x09E6, "thai": 0x0E50}


def fold_digits(x: Column | str) -> Column:
    """Digits of other scripts, and the full-width point and comma, as ASCII."""
    others = "".join(chr(start + k) for start in DIGIT_RUNS.values() for k in range(10))
    return F.translate(_col(x), others + "．，", "0123456789" * len(DIGIT_RUNS) + ".,")


def digit_script(x: Column | str) -> Column:
    """The one script that a text's digits are of, "mixed" for several, null without digits."""
    runs = {"ascii": 0x30} | DIGIT_RUNS
    seen = F.array_compact(F.array(*[F.when(_col(x).rlike(f"[{chr(c)}-{chr(c + 9)}]"), name) for name, c in runs.items()]))
    return F.when(F.size(seen) == 1, F.get(seen, 0)).when(F.size(seen) > 1, "mixed")


#: Numbers that only one decimal mark explains.
POINT, COMMA = r"^([0-9]{1,3}(,[0-9]{3})+\.[0-9]+|[0-9]+\.[0-9]{1,2}|[0-9]{1,3}(,[0-9]{3}){2,})$", r"^([0-9]{1,3}(\.[0-9]{3})+,[0-9]+|[0-9]+,[0-9]{1,2}|[0-9]{1,3}(\.[0-9]{3}){2,})$"


def decimal_mark(tokens: Column) -> Column:
    """The decimal mark of a document from all its numbers: "point", "comma", "mixed" if they disagree, null if none tells."""
    point, comma = F.exists(tokens, lambda t: t.rlike(POINT)), F.exists(tokens, lambda t: t.rlike(COMMA))
    return F.when(point & comma, "mixed").when(point, "point").when(comma, "comma")


def number_tokens(x: Column | str) -> Column:
    """Runs of digits, points and commas that begin and end with a digit."""
    return F.regexp_extract_all(_col(x), F.lit("[0-9][0-9.,]*[0-9]|[0-9]"), F.lit(0))


def adjacent_swaps(x: Column | str) -> Column:
    """Readings of digits with two unlike neighbours swapped, sorted."""
    c = _col(x)
    at = lambda i, n: F.substr(c, i, F.lit(n))
    places = F.when(F.length(c) > 1, F.sequence(F.lit(1), F.length(c) - 1)).when(F.length(c) <= 1, F.array().cast("array<int>"))
    unlike = F.filter(places, lambda i: at(i, 1) != at(i + 1, 1))
    swapped = F.transform(unlike, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), at(i + 1, 1), at(i, 1), F.substr(c, i + 2)))
    return F.array_sort(F.array_distinct(swapped))


def currency_code(x: Column | str) -> Column:
    """A currency as three capitals; null for anything else."""
    code = F.upper(F.trim(_col(x)))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def money_text(x: Column | str) -> Column:
    """Grouped by thousands, with two places."""
    return F.format_number(_col(x).cast("decimal(28,2)"), 2)


#: Signs that a line is more than quantity times price (fixed words).
ADJUSTED = r"(?i)%|\b(discount|disc|rebate|fee|surcharge|tax|vat|gst|credit|freight|shipping|deposit|less)\b"


def adjusted(x: Column | str) -> Column:
    """Whether a line's text names an adjustment: a percent sign, one of some words, a signed or bracketed amount."""
    return _col(x).rlike(ADJUSTED) | _col(x).rlike(r"(^|\s)(-[$€£]?[0-9]|\([$€£]?[0-9][0-9.,]*\))")


def bounded_numbers(x: Column | str) -> Column:
    """The numbers of a text as written, each as long as it goes: a point or comma belongs to one only between digits."""
    return F.regexp_extract_all(_col(x), F.lit("([0-9]+(?:[.,][0-9]+)*)"), 1)


def written_as(x: Column | str, value: Column) -> Column:
    """How a text writes a value, by the first of its surface forms that stands there as a whole number; null if none does."""
    return F.get(F.array_intersect(surface_forms(value), bounded_numbers(x)), 0)
