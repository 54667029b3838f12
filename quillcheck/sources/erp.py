"""Monthly exports of accounting systems: which layout a file has, by its columns, and the bills in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import decimal_text
from ..functions.vendors import told

#: The columns of known layouts, by what they mean; a layout of one's own is one more entry.
LAYOUTS = {
    "generic": {
        "ref": "ref", "invoice_number": "invoice_number", "vendor": "vendor", "date": "date", "currency": "currency", "total": "total", "po": "po",
        "status": "status", "line_id": "line_id", "item": "item", "description": "description", "quantity": "quantity", "rate": "rate", "amount": "amount",
    },
    "netsuite": {
        "ref": "Internal ID", "invoice_number": "Reference No.", "vendor": "Vendor", "date": "Date", "currency": "Currency", "total": "Amount (Transaction Total)", "po": "Created From",
        "status": "Status", "line_id": "Line ID", "item": "Item", "description": "Memo", "quantity": "Quantity", "rate": "Rate", "amount": "Amount",
    },
    "xero": {
        "invoice_number": "InvoiceNumber", "vendor": "ContactName", "date": "InvoiceDate", "currency": "Currency", "total": "Total", "tax": "TaxTotal", "po": "Reference",
        "status": "Status", "item": "InventoryItemCode", "description": "Description", "quantity": "Quantity", "rate": "UnitAmount", "amount": "LineAmount",
    },
}
REQUIRED = ["invoice_number", "date", "total", "po", "item", "quantity", "rate", "amount"]
#: Words for what the buyer did with a bill, in lower case, and what stands before an order's number.
PAID, HELD = ["paid", "paid in full"], ["held", "rejected", "cancelled", "voided", "deleted"]
ORDER_PREFIX = "Purchase Order #"
MEANINGS = sorted({m for layout in LAYOUTS.values() for m in layout})


def layout_of(rows: DataFrame, file: str, row: str, cells: str, layouts: dict[str, dict[str, str]] = LAYOUTS) -> DataFrame:
    """Per file the ``layout`` with the most columns in common, its ``unmapped`` columns and the required ones ``missing``, and
    ``refused``: no layout, ambiguous (two have as many), or missing columns.

    ``rows`` has the file, the row's number and its cells by column name; a file's columns are those of its first row, so a
    file gives one short row whatever its length. Null and empty cells have no columns.
    """
    # few sets of columns first, so that no file's rows are sorted
    sets = rows.groupBy(F.col(file).alias("_f"), F.map_keys(cells).alias("_k")).agg(F.min(row).alias("_row"))
    heads = sets.groupBy("_f").agg(F.min_by("_k", "_row").alias("_c")).select("_f", F.coalesce("_c", F.array().cast("array<string>")).alias("_c"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    judged = F.array(
        *[
            F.struct(
                F.size(F.array_intersect("_c", texts(layout.values()))).alias("known"), F.lit(name).alias("layout"), F.array_sort(F.array_except("_c", texts(layout.values()))).alias("unmapped"),
                F.array_sort(F.array_except(texts(layout[m] for m in REQUIRED if m in layout), "_c")).alias("missing"),
            )
            for name, layout in layouts.items()
        ]
    )
    most = heads.select("_f", judged.alias("_j")).withColumn("_most", F.array_max(F.transform("_j", lambda j: j["known"])))
    best = most.withColumn("_b", F.filter("_j", lambda j: (j["known"] == F.col("_most")) & (F.col("_most") > 0)))
    one = F.get("_b", F.lit(0))
    refused = F.when(F.size("_b") == 0, "no layout").when(F.size("_b") > 1, "ambiguous").when(F.size(one["missing"]) > 0, "missing columns")
    sure = lambda x: F.when(F.size("_b") == 1, x)
    return best.select(F.col("_f").alias(file), sure(one["layout"]).alias("layout"), sure(one["unmapped"]).alias("unmapped"), sure(one["missing"]).alias("missing"), refused.alias("refused"))


def _number(x: Column) -> Column:
    return decimal_text(x).cast("double")


def bill_lines(rows: DataFrame, file: str, row: str, cells: str, layouts: dict[str, dict[str, str]] = LAYOUTS) -> DataFrame:
    """Each row of the files that are not refused as a bill's line: file, row, ref (the bill), the meanings as columns, status as
    ``decision`` (pay, hold or open), and ``problem``: no bill (neither reference nor number), or an unreadable date or number.

    Rows without a reference are one bill only where number, date and vendor are the same as written. A file's layout reaches
    its rows by an equality join; rows are not gathered.
    """
    chosen = layout_of(rows, file, row, cells, layouts).where("refused is null").select(F.col(file).alias("_f"), "layout")
    read = rows.join(chosen, F.col(file).eqNullSafe(F.col("_f")))
    cell = lambda name: told(F.try_element_at(F.col(cells), F.lit(name)))
    meant = {m: F.coalesce(*[F.when(F.col("layout") == n, cell(layout[m])) for n, layout in layouts.items() if m in layout], F.lit(None).cast("string")) for m in MEANINGS}
    read = read.select(file, row, "layout", *[x.alias(m) for m, x in meant.items()])
    po = F.when(F.col("po").startswith(ORDER_PREFIX), told(F.substring(F.col("po"), len(ORDER_PREFIX) + 1, 1000))).otherwise(F.col("po"))
    status = F.lower("status")
    made = F.concat_ws("|", "invoice_number", F.coalesce("date", F.lit("")), F.coalesce("vendor", F.lit("")))
    ref = F.coalesce("ref", F.when(F.col("invoice_number").isNotNull(), made))
    numbers = ["total", "quantity", "rate", "amount"]
    day = F.substring("date", 1, 10).try_cast("date")
    read = read.withColumns({f"_{n}": _number(F.col(n)) for n in [*numbers, "tax"]})
    broken = [F.when(F.col(f"_{n}").isNull() & F.col(n).isNotNull(), f"unreadable {n}") for n in numbers]
    problem = F.coalesce(F.when(ref.isNull(), "no bill"), F.when(day.isNull() & F.col("date").isNotNull(), "unreadable date"), *broken)
    return read.select(
        file, row, "layout", ref.alias("ref"), "invoice_number", "vendor", day.alias("date"), "currency", po.alias("po"), "item", "line_id", "description",
        *[F.col(f"_{n}").alias(n) for n in [*numbers, "tax"]], F.when(status.isin(*PAID), "pay").when(status.isin(*HELD), "hold").otherwise("open").alias("decision"), problem.alias("problem"),
    )


def bills(lines: DataFrame, file: str, row: str) -> DataFrame:
    """Per file and bill: its first row's header, the number of lines, their sum, and how many have a problem; rows without a
    bill are left out here, and stay in ``bill_lines``. Rows with one header are summed before the shuffle, so that only a
    bill's different headers meet, not its lines."""
    header = ["invoice_number", "vendor", "date", "currency", "po", "total", "decision"]
    own = lines.where("ref is not null").groupBy(file, "layout", "ref", *header)
    own = own.agg(F.min(row).alias("_row"), F.count("*").alias("n"), F.sum("amount").alias("s"), F.count("problem").alias("p"))
    sums = [F.sum("n").alias("n_lines"), F.sum("s").alias("lines_sum"), F.sum("p").alias("n_problems")]
    found = own.groupBy(file, "layout", "ref").agg(F.min_by(F.struct(*header), "_row").alias("h"), *sums)
    return found.select(file, "layout", "ref", "h.*", "n_lines", "lines_sum", "n_problems")
