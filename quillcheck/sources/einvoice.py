"""Electronic invoices as XML, UBL and the Polish national form, read into columns and held against their own sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import outcome
from ..operators.claims import Check

_SUM = "struct<_VALUE: decimal(18,6), _currencyID: string>"
_LINE = (
    f"ID: string, InvoicedQuantity: struct<_VALUE: decimal(18,6)>, LineExtensionAmount: {_SUM}, AllowanceCharge: array<struct<ChargeIndicator: string, Amount: {_SUM}>>, "
    f"Price: struct<PriceAmount: {_SUM}, BaseQuantity: struct<_VALUE: decimal(18,6)>>"
)
_TOTALS = ("LineExtension", "TaxExclusive", "TaxInclusive", "AllowanceTotal", "ChargeTotal", "Prepaid", "PayableRounding", "Payable")
#: Names of the two forms' elements, as far as they are read.
SCHEMA = (
    "CustomizationID string, ProfileID string, ID string, DocumentCurrencyCode string, "
    f"TaxTotal array<struct<TaxAmount: {_SUM}, TaxSubtotal: array<struct<TaxAmount: {_SUM}>>>>, "
    f"LegalMonetaryTotal struct<{', '.join(f'{n}Amount: {_SUM}' for n in _TOTALS)}>, InvoiceLine array<struct<{_LINE}>>, "
    "Fa struct<KodWaluty: string, P_2: string, P_15: decimal(18,6), FaWiersz: array<struct<NrWierszaFa: string, P_8B: decimal(18,6), P_9A: decimal(18,6), P_10: decimal(18,6), P_11: decimal(18,6)>>>"
)
PEPPOL, ZATCA, KSEF = "peppol-bis3", "zatca-ksa", "ksef-fa3"
_DECIMAL = "decimal(18,6)"


def read(docs: DataFrame, xml: str, keys: list[str]) -> DataFrame:
    """One row a document: the keys, profile, number, currency, the totals as stated and ``lines`` (id, quantity, price,
    base, net, allowances, charges; the last two null where a line's cannot be read). Documents that are no XML, of no known
    profile, or with a markup declaration (no entities are expanded) have a null profile and no values. Amounts in another
    currency than the invoice's are not read."""
    declared = F.col(xml).contains("<!") & F.col(xml).rlike(r"<!(DOCTYPE|ENTITY|ELEMENT)")  # most texts are spared the pattern
    safe = F.when(~declared, F.col(xml))
    x = docs.select(F.struct(*keys).alias("_key"), F.from_xml(safe, SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x")).select("_key", "x.*")
    ubl = F.when(F.col("CustomizationID").contains("urn:fdc:peppol.eu:2017:poacc:billing:3.0"), PEPPOL).when(F.col("ProfileID").startswith("reporting:"), ZATCA)
    x = x.withColumn("profile", F.when(F.col("Fa").isNotNull(), KSEF).otherwise(ubl))
    x = x.withColumn("currency", F.coalesce("DocumentCurrencyCode", "Fa.KodWaluty"))
    amount = lambda s: F.when(F.coalesce(s["_currencyID"], F.col("currency")) == F.col("currency"), s["_VALUE"])

    def allowed(line: Column, flag: str) -> Column:
        each = F.coalesce(line["AllowanceCharge"], F.array())
        bad = F.exists(each, lambda a: ~F.coalesce(F.trim(a["ChargeIndicator"]).isin("true", "false") & amount(a["Amount"]).isNotNull(), F.lit(False)))
        own = F.filter(each, lambda a: F.trim(a["ChargeIndicator"]) == flag)
        return F.when(~bad, F.aggregate(own, F.lit(0).cast(_DECIMAL), lambda s, a: (s + amount(a["Amount"])).cast(_DECIMAL)))

    def ubl_line(line: Column) -> Column:
        base = F.when(line["Price"]["BaseQuantity"].isNull(), F.lit(1).cast(_DECIMAL)).otherwise(line["Price"]["BaseQuantity"]["_VALUE"])
        parts = (line["ID"], line["InvoicedQuantity"]["_VALUE"], amount(line["Price"]["PriceAmount"]), base, amount(line["LineExtensionAmount"]), allowed(line, "false"), allowed(line, "true"))
        return F.struct(*[c.alias(n) for c, n in zip(parts, _PARTS)])

    def ksef_line(line: Column) -> Column:
        parts = (line["NrWierszaFa"], line["P_8B"], line["P_9A"], F.lit(1).cast(_DECIMAL), line["P_11"], F.coalesce(line["P_10"], F.lit(0).cast(_DECIMAL)), F.lit(0).cast(_DECIMAL))
        return F.struct(*[c.alias(n) for c, n in zip(parts, _PARTS)])

    lines = F.when(F.col("profile") == KSEF, F.transform("Fa.FaWiersz", ksef_line)).otherwise(F.transform("InvoiceLine", ubl_line))
    # of two tax totals the one that is broken down is the invoice's; the other is in the currency of the books
    split = F.filter("TaxTotal", lambda z: z["TaxSubtotal"].isNotNull())
    tax = F.when(F.size(split) == 1, amount(F.get(split, F.lit(0))["TaxAmount"]))
    stated = [amount(F.col(f"LegalMonetaryTotal.{n}Amount")).alias(_snake(n)) for n in _TOTALS[:-1]]
    payable = F.coalesce(amount(F.col("LegalMonetaryTotal.PayableAmount")), "Fa.P_15").alias("payable")
    known = x.select("_key", "profile", F.coalesce("ID", "Fa.P_2").alias("number"), "currency", tax.alias("tax"), *stated, payable, lines.alias("lines"))
    values = [c for c in known.columns if c not in ("_key", "profile")]
    return known.select("_key.*", "profile", *[F.when(F.col("profile").isNotNull(), F.col(c)).alias(c) for c in values])


_PARTS = ("id", "quantity", "price", "base", "net", "allowances", "charges")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


def _cents(text: str) -> str:
    return f"round({text}, 2)"


#: The totals' rules of EN 16931, exact to the cent.
TOTALS = [
    Check("BR-CO-10", "=", _cents("line_extension"), _cents("lines_net"), tol=0),
    Check("BR-CO-13", "=", _cents("tax_exclusive"), _cents("line_extension - coalesce(allowance_total, 0) + coalesce(charge_total, 0)"), tol=0),
    Check("BR-CO-15", "=", _cents("tax_inclusive"), _cents("tax_exclusive + tax"), tol=0),
    Check("BR-CO-16", "=", _cents("payable"), _cents("tax_inclusive - coalesce(prepaid, 0) + coalesce(payable_rounding, 0)"), tol=0),
]


def line_math(line: Column, slack: float = 0.02) -> Column:
    """Whether a line's net is quantity times price per base quantity, plus charges, less allowances; exact within the slack."""
    d = lambda c: line[c].cast("decimal(18,6)")
    due = F.try_divide((d("quantity") * d("price")).cast("decimal(28,10)"), d("base")) + d("charges") - d("allowances")
    return outcome(F.abs(d("net") - due) <= F.lit(slack).cast(_DECIMAL))


def lines_net(lines: Column) -> Column:
    """What the lines come to; null if there are none or one has no net."""
    total = F.aggregate(lines, F.lit(0).cast(_DECIMAL), lambda s, x: (s + x["net"]).cast(_DECIMAL))
    return F.when(F.size(lines) > 0, total)
