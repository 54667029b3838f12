"""Facts out of free text and markup, by built-in patterns only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import decimal_text

REPORTERS = ("U.S.", "S. Ct.", "F.2d", "F.3d", "F.4th", "F. Supp. 2d", "F. Supp. 3d")


def each_match(text: Column, pattern: str, groups: int) -> Column:
    """An array with one array of groups for each match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
    return F.transform(F.arrays_zip(*[f.alias(f"g{k}") for k, f in enumerate(found)]), lambda x: F.array(*[x[f"g{k}"] for k in range(groups)]))


def citations(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Each citation by volume, reporter and page that a text has."""
    names = "|".join(r.replace(".", r"\.") for r in REPORTERS)
    found = docs.select(*keep, F.explode(each_match(F.col(text), rf"\b([0-9]{{1,4}}) ({names}) ([0-9]{{1,6}})\b", 3)).alias("m"))
    return found.select(*keep, F.col("m")[0].cast("int").alias("volume"), F.col("m")[1].alias("reporter"), F.col("m")[2].cast("int").alias("page"))


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1), F.lit(""))


def numeric_facts(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Each inline numeric fact: concept, context, unit and value, by its scale and sign; null for text that is no number.
    A dash, as some forms write nothing, is zero."""
    tags = F.explode(each_match(F.col(html), r"<ix:nonFraction\b([^>]*)>([^<]*)</ix:nonFraction>", 2)).alias("m")
    rows = pages.select(*keep, tags).select(*keep, F.col("m")[0].alias("tag"), F.trim(F.col("m")[1]).alias("shown"))
    shown = F.when(F.col("shown").isin("-", "—", "–"), "0").otherwise(F.col("shown"))
    value = decimal_text(shown).cast("double") * F.pow(F.lit(10.0), F.coalesce(_attribute(F.col("tag"), "scale").try_cast("int"), F.lit(0)))
    value = F.when(_attribute(F.col("tag"), "sign") == "-", -value).otherwise(value)
    return rows.select(
        *keep, _attribute(F.col("tag"), "name").alias("concept"), _attribute(F.col("tag"), "contextRef").alias("context"), _attribute(F.col("tag"), "unitRef").alias("unit"), value.alias("value")
    )


def bill_fields(mails: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Header fields and lines of a bill sent as text: number, order, total, and lines of description, quantity at price."""
    t = F.col(text)
    one = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    lines = each_match(t, r"(?m)^\s*(.+?)\s{2,}([0-9.]+) @ ([0-9.,]+) = ([0-9.,]+)\s*$", 4)
    return mails.select(
        *keep, one(r"(?im)^\s*invoice(?: no\.?| number)?[:#]?\s*(\S+)").alias("number"), one(r"(?im)^\s*(?:po|purchase order)[:#]?\s*(\S+)").alias("po"),
        decimal_text(one(r"(?im)^\s*total(?: due)?:?\s*\$?([0-9.,]+)")).cast("double").alias("total"),
        F.transform(lines, lambda m: F.struct(m[0].alias("description"), m[1].try_cast("double").alias("quantity"), decimal_text(m[2]).cast("double").alias("price"), decimal_text(m[3]).cast("double").alias("amount"))).alias("lines"),
    )


def run_counts(output: Column) -> Column:
    """struct(passed, failed) of a test run's last summary; null where it has none."""
    one = lambda w: F.element_at(F.regexp_extract_all(output, F.lit(rf"([0-9]+) {w}"), F.lit(1)), -1).try_cast("int")
    some = output.rlike(r"[0-9]+ (passed|failed)")
    return F.when(some, F.struct(F.coalesce(F.when(output.rlike("[0-9]+ passed"), one("passed")), F.lit(0)).alias("passed"), F.coalesce(F.when(output.rlike("[0-9]+ failed"), one("failed")), F.lit(0)).alias("failed")))


def done_claims(text: Column) -> Column:
    """Sentences that claim something done, without those that hedge or deny."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    claims = r"(?i)\b(all tests pass|is (now )?(fixed|done|complete)|has been (fixed|implemented|deployed))\b"
    return F.filter(sentences, lambda s: s.rlike(claims) & ~s.rlike(r"(?i)\b(should|might|may|could|not|never|unless|once|if)\b"))


def name_words(name: Column) -> Column:
    """Words of a tool's name, whether written in camel case or with separators."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.split(F.lower(F.trim(spaced)), " ")


def equivalence(a: Column, b: Column, kind: str) -> Column:
    """identical, equivalent or different, by what two texts say as text, amount, identifier or date; null if unread."""
    from ..functions.numbers import amount
    from ..functions.text import identifier_key, quotable
    from .binding import read_date

    read = {"text": quotable, "amount": amount, "identifier": identifier_key, "date": lambda x: read_date(x)["date"]}[kind]
    x, y = read(a), read(b)
    return F.when(a == b, "identical").when(x.isNull() | y.isNull(), None).when(x == y, "equivalent").otherwise("different")


#: Fixed values, to agree with other implementations: what an order says of freight when it may not be billed, ...
FREIGHT_REFUSED = ("not allowed", "not permitted", "no freight", "included in price", "vendor pays")
#: ... what it says when it may be, unless it says one of the above too, ...
FREIGHT_ALLOWED = ("allowed", "permitted", "may be added", "billable", "added by the vendor")
#: ... and what it says of a tax rate of zero.
UNTAXED = ("0", "none", "exempt", "tax exempt", "tax-exempt", "no tax", "not taxable", "nontaxable", "non-taxable")


def _cells(line: Column) -> Column:
    """What stands between the bars of a line."""
    return F.transform(F.split(line, r"\|"), lambda cell: F.trim(F.translate(cell, "\t\r", "  ")))


def _measured(text: str, measures: dict[str, bool], named: bool = True) -> Column:
    """An array of the numbered lines of ``measured_lines``; the name is left out unless ``named``."""
    n = len(measures)
    shapes = [rf"^{word}[ \t]*{'[A-Z]{3}' if money else ''}[ \t]*([0-9,.]+)$" for word, money in measures.items()]

    def read(cells: Column) -> Column:
        first = F.get(cells, F.lit(0))
        own = lambda k: F.get(cells, F.size(cells) - n + k)
        fits = (F.size(cells) > n) & first.rlike(r"^[0-9]+\.[ \t]*.")
        for k, shape in enumerate(shapes):
            fits = fits & own(k).rlike(shape)
        number = F.regexp_extract(first, r"^([0-9]+)\.", 1).try_cast("int")
        name = F.array_join(F.slice(cells, 1, F.size(cells) - n), " | ")
        names = [F.regexp_replace(name, r"^[0-9]+\.[ \t]*", "").alias("name")] if named else []
        value = lambda k, shape: F.replace(F.regexp_extract(own(k), shape, 1), F.lit(",")).try_cast("decimal(18,4)")
        found = [value(k, shape).alias(word) for k, (word, shape) in enumerate(zip(measures, shapes))]
        return F.when(fits, F.struct(number.alias("line"), *names, *found))

    # a line's cells are bound by a lambda, so that they are cut once for all that is read from them
    lines = F.transform(F.transform(F.split(text, "\n"), _cells), read)
    return F.filter(lines, lambda l: l.isNotNull())


def measured_lines(mails: DataFrame, keep: list[str], text: str, measures: dict[str, bool]) -> DataFrame:
    """Numbered lines whose last cells are the given measures: ``line``, ``name`` and a column for each measure.

    A line is cells between bars. The first begins with a number and a point; the last ones say, in order, a measure's word
    and its number, after a currency's three capitals if the measure is money. The cells before are the name. Lines of
    other shapes give no row; a number that does not read is null.
    """
    return mails.select(*keep, F.explode(_measured(text, measures)).alias("_l")).select(*keep, "_l.*")


def _bound(x: Column, use) -> Column:
    """``use(x)`` with x worked out once, however often it stands there."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


#: What lines of orders and receipts say last.
ORDERED, RECEIVED = {"qty": False, "unit": True}, {"received": False}


def order_lines(mails: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The lines of purchase orders written as text, "1. name | qty 2 | unit USD 3.00": ``line``, ``name``, ``qty``, ``unit``."""
    return measured_lines(mails, keep, text, ORDERED)


def receipt_lines(mails: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The lines of goods receipts written as text, "1. name | received 2": ``line``, ``name``, ``received``."""
    return measured_lines(mails, keep, text, RECEIVED)


def lines_received(mails: DataFrame, key: str, order: str, receipt: str) -> DataFrame:
    """The lines of orders with what the receipts beside them say came: the key, ``line``, ``qty``, ``unit``, ``received`` (all
    that the receipts of a key say of a line's number; null if none does).

    Each text is read once, and lines of a key stay where its texts are if these are by key.
    """
    none = lambda c: F.lit(None).cast("decimal(18,4)").alias(c)
    ordered = F.transform(_measured(order, ORDERED, named=False), lambda x: F.struct(x["line"].alias("line"), x["qty"].alias("qty"), x["unit"].alias("unit"), none("got"), F.lit(True).alias("own")))
    came = F.transform(_measured(receipt, RECEIVED, named=False), lambda x: F.struct(x["line"].alias("line"), none("qty"), none("unit"), x["received"].alias("got"), F.lit(False).alias("own")))
    both = F.concat(F.coalesce(ordered, F.array()), F.coalesce(came, F.array()))
    rows = mails.select(key, F.explode(both).alias("_l")).select(key, "_l.*")
    told = F.when(F.col(key).isNotNull() & F.col("line").isNotNull(), F.sum("got").over(W.partitionBy(key, "line")))
    return rows.withColumn("received", told).where("own").select(key, "line", "qty", "unit", "received")


def order_terms(
    text: Column, refused: tuple[str, ...] = FREIGHT_REFUSED, allowed: tuple[str, ...] = FREIGHT_ALLOWED, untaxed: tuple[str, ...] = UNTAXED
) -> dict[str, Column]:
    """A purchase order's ``number``, whether ``freight`` may be billed, and its ``tax`` rate; null where it does not say.

    Terms are cells "label: value" of lines that are not numbered, in any case; of cells with one label the first counts.
    The freight's label is freight, a tax rate's ends with tax or tax rate. The number is the last word, PO- and digits, of
    the cell before the vendor's.
    """
    own = F.split(text, "\n")
    about = F.filter(own, lambda l: l.contains(":") & F.lower(l).rlike("freight|tax"))  # no other line can tell a term
    heads = F.filter(F.transform(about, _cells), lambda cells: ~F.get(cells, F.lit(0)).rlike(r"^[0-9]+\.([ \t]|$)"))
    cells = F.transform(F.flatten(heads), F.lower)
    label = lambda c: F.trim(F.substring_index(c, ":", 1))
    told = lambda wanted: F.trim(F.regexp_replace(F.get(F.filter(cells, lambda c: c.contains(":") & label(c).rlike(wanted)), F.lit(0)), r"^[^:]*:", ""))
    says = lambda x, phrases: reduce(or_, [F.contains(x, F.lit(p)) for p in phrases])

    def rate(tax: Column) -> Column:
        share = lambda x: F.when((x >= 0) & (x <= 1), F.round(x, 9).cast("double"))
        told_share = F.when(tax.endswith("%"), F.trim(F.rtrim(tax, F.lit("%"))).try_cast("decimal(12,9)") / 100)
        return F.when(tax.isin(*untaxed), 0.0).otherwise(_bound(told_share, share))

    vendors = F.transform(F.filter(own, lambda l: l.contains("PO-") & l.contains("Vendor")), _cells)
    pairs = F.flatten(F.transform(vendors, lambda cells: F.transform(cells, lambda c, k: F.struct(c.alias("cell"), F.get(cells, k + 1).alias("next")))))
    order = F.get(F.filter(pairs, lambda p: p["cell"].rlike(r"\bPO-[0-9]+$") & p["next"].startswith("Vendor")), F.lit(0))["cell"]
    return {
        "number": F.nullif(F.regexp_extract(order, "PO-[0-9]+$", 0), F.lit("")),
        "freight": _bound(told(r"(^|\W)freight$"), lambda x: F.when(says(x, refused), False).when(says(x, allowed), True)),
        "tax": _bound(told(r"(^|\W)tax([ \t]+rate)?$"), rate),
    }
