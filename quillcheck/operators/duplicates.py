"""Resubmissions: pairs of records that are the same, or the same but for how they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.outcome import FAIL, OPEN, PASS
from ..functions.text import base_id, document_number, plain_width, spoken, tight_id, vendor_name
from ..functions.vendors import loose_number, name_relation, name_sides, near_reasons, sides_alike, tax_id, told, told_match
from ..session import cut
from .lookalikes import may_look_alike


def nearest_earlier(rows: DataFrame, key: str, order: str, tiers: dict[str, list[str]]) -> DataFrame:
    """Per row the strongest tier at which an earlier row is its duplicate, and the first such row.

    ``tiers`` names the columns of each tier, strongest first; two rows are duplicates at a tier if they are equal in all of
    them, and a row that lacks one is nobody's duplicate there. The first row of each value is found by aggregation and
    joined back, so a group of any size costs its rows and no pairs, and a common value can be split as a skewed one.
    """
    out = rows
    for k, (name, columns) in enumerate(tiers.items()):
        value = F.when(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)), F.struct(*[F.col(c).alias(f"m{i}") for i, c in enumerate(columns)]))
        firsts = rows.select(value.alias("_v"), F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("f")).where("_v is not null")
        firsts = firsts.groupBy(F.col("_v").alias(f"_w{k}")).agg(F.min("f")["k"].alias("_first"))
        out = out.withColumn(f"_v{k}", value).join(firsts, F.col(f"_v{k}") == F.col(f"_w{k}"), "left")
        found = F.struct(F.lit(k + 1).alias("tier"), F.lit(name).alias("kind"), F.col("_first").alias("earlier"))
        out = out.withColumn(f"_f{k}", F.when(F.col("_first") != F.col(key), found)).drop("_first", f"_v{k}", f"_w{k}")
    best = F.coalesce(*[F.col(f"_f{k}") for k in range(len(tiers))])
    return out.select(*rows.columns, best["tier"].alias("tier"), best["kind"].alias("kind"), best["earlier"].alias("earlier"))


def written_alike(rows: DataFrame, id_col: str) -> DataFrame:
    """Each identifier with its tight form, base form and folded number."""
    return rows.withColumns({"tight": tight_id(id_col), "base": base_id(id_col), "folded": document_number(id_col)})


#: Tiers of a duplicate claim, strongest first, and what each says of the bill.
LADDER = {
    "same number, same vendor": FAIL, "same number, vendor variant": FAIL, "same number, look-alike vendor": FAIL,
    "same number, vendor in doubt": OPEN, "number written otherwise": OPEN, "same order and total": OPEN,
}


#: Places of a list, in order of ids, by which a first round looks for a name that is alike; each further round takes eight times as many.
FIRST_PLACES = 8_192


def duplicate_claims(bills: DataFrame, booked: DataFrame, tolerance: float = 0.01, places: int = FIRST_PLACES) -> DataFrame:
    """Per bill whether it is booked already: bill, outcome, tier, kind, booked (the first booked row of that tier), match.

    Both tables have id, number, vendor, tax, vendor_id, po and total; missing and blank values match nothing. A bill
    meets booked rows of its number, its number read loosely, or its order and total (within the tolerance). What a tier
    asks of them but for look-alike names are equalities, so the first booked row of each value is found by aggregation and
    no pairs are made. Names alike are looked for among the distinct names booked under the number, in order of their first
    rows, and only until one is found; no pair of names is shuffled. The row found is then held against the bill in full.
    The strongest tier decides: FAIL, or open for a person to look at; PASS where none applies. Without any booked
    row all bills pass; rows that repeat count once for each bill.
    """
    columns = ["id", "number", "vendor", "tax", "vendor_id", "po", "total"]
    sides = []
    for rows, p in ((bills, "b_"), (booked, "h_")):
        as_is = ("id", "total")
        rows = rows.select(*[(F.col(c) if c in as_is else told(c)).alias(p + c) for c in columns])
        rows = rows.withColumn(p + "tax", tax_id(p + "tax")).withColumn(p + "exact", told(F.upper(plain_width(p + "number")))).withColumn(p + "loose", F.nullif(loose_number(p + "number"), F.lit("")))
        sides.append(cut(_features(rows, p, tolerance)))
    asking, asked = (rows.select("f.*") for rows in sides)
    asking = asking.where("id is not null")
    bill, book = (rows.drop("f") for rows in sides)
    best = cut(_strongest([_first_equal(asking, asked, (1, 2, 4), tolerance)]))
    rest = asking.join(best, "id", "left").where("tier is null or tier > 2")
    best = cut(_strongest([best, _first_alike(rest, asked, (3, 4), tolerance, places)]))
    rest = asking.join(best.select("id"), "id", "left_anti")
    late = cut(_strongest([_first_equal(rest, asked, (5, 6), tolerance)]))
    late = _strongest([late, _first_alike(rest.join(late, "id", "left"), asked, (5, 6), tolerance, places)])
    best = best.unionByName(late).select(F.col("id").alias("b_id"), F.col("first.id").alias("_h"))
    pairs = bill.join(best, "b_id").join(book, F.col("_h").eqNullSafe(F.col("h_id"))).drop("_h")
    names = pairs.select("b_vendor", "h_vendor").distinct().where("b_vendor is not null and h_vendor is not null")
    names = near_reasons(names, "b_vendor", "h_vendor")
    relation = name_relation(F.col("h_vendor"), F.col("b_vendor"), F.col("reason")).alias("relation")
    pairs = pairs.join(names.select("b_vendor", "h_vendor", relation), ["b_vendor", "h_vendor"], "left")
    relation = F.coalesce("relation", F.lit("unknown"))
    match = told_match(relation, (F.col("h_tax"), F.col("b_tax")), (F.col("h_vendor_id"), F.col("b_vendor_id")))
    pairs = pairs.withColumn("match", match)
    no = F.lit(False)
    exact = F.coalesce(F.col("b_exact") == F.col("h_exact"), no)
    loose = F.coalesce(F.col("b_loose") == F.col("h_loose"), no) & ~exact
    same_po = F.coalesce(F.col("b_po") == F.col("h_po"), no)
    same_total = F.coalesce(F.abs(F.col("b_total") - F.col("h_total")) <= tolerance, no)
    one = ~F.col("match").isin("different", "conflict")
    doubt = (F.col("match") == "conflict") | ((F.col("match") == "different") & (same_po | same_total))
    rules = [exact & F.col("match").isin("same", "unknown"), exact & (F.col("match") == "variant"), exact & (F.col("match") == "near"), exact & doubt, loose & one, same_po & same_total & one]
    tier = F.coalesce(*[F.when(rule, k + 1) for k, rule in enumerate(rules)])
    found = pairs.withColumn("tier", tier).where("tier is not null").groupBy("b_id")
    best = found.agg(F.min(F.struct("tier", F.col("h_id").alias("booked"), "match")).alias("m")).select(F.col("b_id").alias("id"), "m.*")
    kind, outcome = F.lit(None).cast("string"), F.lit(PASS)
    for k, (name, said) in enumerate(LADDER.items()):
        kind, outcome = F.when(F.col("tier") == k + 1, name).otherwise(kind), F.when(F.col("tier") == k + 1, said).otherwise(outcome)
    out = bills.select("id").distinct().join(best, "id", "left")
    return out.select("id", outcome.alias("outcome"), "tier", kind.alias("kind"), "booked", "match")


def _features(rows: DataFrame, p: str, tolerance: float) -> DataFrame:
    """Rows with what tiers compare, as struct f: id, exact, loose, po, total and its cell, tax, vid, the name as it compares (low, bare) and as spoken."""
    cell = F.floor(F.col(p + "total") / (2 * tolerance) + F.lit(0.5)).cast("long")
    vendor = F.col(p + "vendor")
    compared = F.struct(
        *[F.col(p + c).alias(c) for c in ("id", "exact", "loose", "po", "total")], cell.alias("cell"), F.col(p + "tax").alias("tax"), F.col(p + "vendor_id").alias("vid"),
        F.lower(vendor).alias("low"), vendor_name(vendor).alias("bare"), spoken(vendor).alias("name"),
    )
    return rows.withColumn("f", compared)


def _entries(rows: DataFrame, tiers: tuple[int, ...], asks: bool) -> DataFrame:
    """A row each value by which a row can be found at a tier, or by which it looks: the tier, ``by``, the key, the value, which
    rows it may meet by their missing tax numbers and vendor ids (``without``), the total's cell, and the total where that counts.

    Two tax numbers decide before all else, and two vendor ids before names: a bill with a tax number looks for what its
    vendor id or name says among booked rows without one, and alike for vendor ids. What a tier asks is complete only where
    no stronger tier has a row.
    """
    untaxed, no_id, unnamed = F.col("tax").isNull(), F.col("vid").isNull(), F.col("low").isNull()
    always, blank = F.lit(True), F.lit("")
    # (whether a row has this mark, the mark): one for a bill, for a booked row all marks under which it may be met
    free = [(always, F.lit(0))]
    no_tax = [(always, F.when(untaxed, 0).otherwise(1))] if asks else [(always, F.lit(0)), (untaxed, F.lit(1))]
    neither = [(always, F.when(untaxed, 0).otherwise(1) + F.when(no_id, 0).otherwise(2))] if asks else [(always, F.lit(0)), (untaxed, F.lit(1)), (no_id, F.lit(2)), (untaxed & no_id, F.lit(3))]
    cells = [F.col("cell") + k for k in ((-1, 0, 1) if asks else (0,))]
    one = {  # same, variant or unknown, in whatever tier
        "tax": (F.col("tax"), free), "id": (F.col("vid"), no_tax),
        "any": (F.when(unnamed, blank) if asks else blank, neither), "unnamed": (F.when(~unnamed if asks else unnamed, blank), neither),
    }
    same, variant = {"name": (F.col("low"), neither)}, {"bare": (F.col("bare"), no_tax)}
    doubt = {"conflict": (F.when(~untaxed, F.col("bare")), free), "order": (F.col("po"), free), "total": (blank, free)}
    wanted = {1: ("exact", one | same), 2: ("exact", variant), 4: ("exact", doubt), 5: ("loose", one | variant), 6: ("po", one | variant)}
    found = []
    for tier in tiers:
        key, values = wanted[tier]
        for by, (value, marks) in values.items():
            counts = tier == 6 or by == "total"
            for has, mark in marks:
                for at in cells if counts else [F.lit(0).cast("long")]:
                    parts = {"tier": F.lit(tier), "by": F.lit(by), "key": F.col(key), "value": value, "without": mark, "at": at, "total": F.col("total") if counts else F.lit(None).cast("double")}
                    ok = has & F.col(key).isNotNull() & value.isNotNull() & at.isNotNull()
                    found.append(F.when(ok, F.struct(*[v.alias(n) for n, v in parts.items()])))
    return rows.select("id", F.explode(F.array(*found)).alias("e")).where("e is not null").select("id", "e.*")


def _near_totals(tolerance: float):
    return F.col("total").isNull() | F.coalesce(F.abs(F.col("total") - F.col("_total")) <= tolerance, F.lit(False))


def _first_equal(asking: DataFrame, asked: DataFrame, tiers: tuple[int, ...], tolerance: float) -> DataFrame:
    """id, tier, first: the first booked row for each value that a bill looks for."""
    keys = ["tier", "by", "key", "value", "without", "at"]
    firsts = _entries(asked, tiers, False).groupBy(*keys, F.col("total").alias("_total")).agg(F.min(F.struct("id")).alias("first"))
    return _entries(asking, tiers, True).join(firsts, keys).where(_near_totals(tolerance)).select("id", "tier", "first")


def _strongest(found: list[DataFrame]) -> DataFrame:
    """The strongest tier of each bill, and the first booked row of that tier."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("id").agg(F.min(F.struct("tier", "first")).alias("m")).select("id", "m.*")


def _first_alike(asking: DataFrame, asked: DataFrame, tiers: tuple[int, ...], tolerance: float, places: int) -> DataFrame:
    """id, tier, first: the first booked row whose vendor's name looks alike, for bills with the ``tier`` and ``first`` that
    they have so far (null: none); rows that could not better those are not compared.

    A bill with a tax number finds look-alikes among rows without one; those with one are in conflict (tier 4). The names
    under a key stand in order of their first rows. Rounds take more and more of them, and whoever has found one is out.
    """
    taxed = F.col("tax").isNotNull()
    keys = ["near", "key", "list", "at"]

    def listed(rows: DataFrame, asks: bool) -> DataFrame:
        found = []
        for tier in tiers:
            key = F.col({5: "loose", 6: "po"}.get(tier, "exact"))
            mine = [(F.lit(True), F.when(taxed, "free").otherwise("all"))] if asks else [(F.lit(True), F.lit("all")), (~taxed, F.lit("free"))]
            mine = [(taxed, F.lit("taxed"))] if tier == 4 else mine
            better = F.col("tier").isNull() | (F.col("tier") >= tier) if asks else F.lit(True)
            for has, which in mine:
                for at in [F.col("cell") + k for k in ((-1, 0, 1) if asks else (0,))] if tier == 6 else [F.lit(0).cast("long")]:
                    parts = {"near": F.lit(tier), "key": key, "list": which, "at": at, "total": F.col("total") if tier == 6 else F.lit(None).cast("double")}
                    found.append(F.when(has & better & key.isNotNull() & at.isNotNull(), F.struct(*[v.alias(n) for n, v in parts.items()])))
        kept = [c for c in ("id", "name", "tier", "first") if c in rows.columns]
        return rows.where("name <> ''").select(*kept, F.explode(F.array(*found)).alias("e")).where("e is not null").select(*kept, "e.*")

    looking = cut(listed(asking, True))
    bound = F.when(F.col("tier") == F.col("near"), F.col("first"))
    asks = cut(looking.groupBy(*keys, "name", "total").agg(F.bool_or(bound.isNull()).alias("_open"), F.max(bound).alias("_below")))
    named = listed(asked, False).join(asks.groupBy(*keys).agg(F.count("*").alias("_askers")), keys)
    named = named.groupBy(*keys, "_askers", "name", F.col("total").alias("_total")).agg(F.min(F.struct("id")).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first", "name", "_total")
    named = cut(named.withColumn("_place", F.row_number().over(order)))
    lists = named.groupBy(*keys).agg(F.max("_place").alias("_last"), F.max("_askers").alias("_askers"))
    asks = cut(asks.join(lists, keys).withColumn("_ask", F.monotonically_increasing_id()))
    done, begin, end = [], 0, places
    while n := asks.count():
        parts = max(asks.sparkSession.sparkContext.defaultParallelism * 4, n // 20_000)  # few bytes are much work, so parts are not merged
        mine = name_sides(asks.withColumn("_last", F.least("_last", F.lit(end))), "name", "x")
        theirs = name_sides(named.where((F.col("_place") > begin) & (F.col("_place") <= end)), "name", "y")
        met = may_look_alike(mine, theirs, keys, begin, tolerance, parts).where(F.col("_open") | (F.col("_first") < F.col("_below")))
        hit = sides_alike(met, "x", "y").groupBy("_ask").agg(F.min(F.when(F.col("alike"), F.col("_first"))).alias("_found"))
        hit = cut(hit.where("_found is not null"))
        done.append(asks.join(hit, "_ask").select(*keys, "name", "total", "_found"))
        asks = cut(asks.join(hit, "_ask", "left_anti").where(F.col("_last") > end))
        begin, end = end, end * 8
    found = looking.select("id", *keys, "name", "total")
    if not done:
        return found.where("false").select("id", F.col("near").alias("tier"), F.lit(None).cast(asked.select(F.struct("id")).schema[0].dataType).alias("first"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    right = out.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "name"]], F.col("total").alias("_total"), "_found")
    same = F.col("total").eqNullSafe(F.col("_total"))
    for c in [*keys, "name"]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return found.join(right, same).select("id", F.col("near").alias("tier"), F.col("_found").alias("first"))
