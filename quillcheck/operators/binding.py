"""From documents as they come to values with a status: paths, candidates, alignment and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.outcome import words


def bind(doc: Column, paths: list[str], kind: str, default: object = None) -> Column:
    """struct(value, status, path) of a VARIANT document: the first path that is there decides.

    ok if it reads as ``kind``, unparseable if not (null, blank and UNREADABLE are seen but not read, so no default
    applies), defaulted or missing if no path is there.
    """
    out = F.struct(F.lit(default).cast(kind).alias("value"), F.lit("missing" if default is None else "defaulted").alias("status"), F.lit(None).cast("string").alias("path"))
    for path in reversed(paths):
        raw = F.try_variant_get(doc, path, "string")
        here = F.schema_of_variant(F.try_variant_get(doc, path, "variant")).isNotNull()
        value = F.try_variant_get(doc, path, kind) if kind != "string" else F.nullif(F.nullif(F.trim(raw), F.lit("")), F.lit("UNREADABLE"))
        read = F.struct(value.cast(kind).alias("value"), F.when(value.isNotNull(), "ok").otherwise("unparseable").alias("status"), F.lit(path).alias("path"))
        out = F.when(here, read).otherwise(out)
    return out


def align(a: DataFrame, b: DataFrame, doc: str, item: str, order: str) -> DataFrame:
    """Lines of two readings side by side: by item where items are unique in a document on both sides, else by place."""

    def prepared(df: DataFrame, side: str) -> DataFrame:
        w = W.partitionBy(doc)
        place = F.row_number().over(w.orderBy(order)).alias("_place")
        unique = (F.count("*").over(w) == F.size(F.collect_set(item).over(w))).alias("_unique")
        return df.select(doc, F.col(item).alias(f"{side}_item"), F.col(order).alias(f"{side}_order"), place, unique)

    x, y = prepared(a, "a"), prepared(b, "b")
    sound = x.groupBy(doc).agg(F.first("_unique").alias("u")).join(y.groupBy(doc).agg(F.first("_unique").alias("v")), doc, "full_outer")
    sound = sound.select(doc, (F.coalesce("u", F.lit(True)) & F.coalesce("v", F.lit(True))).alias("_by_item"))
    key = lambda side: F.when(F.col("_by_item"), F.concat(F.lit("i"), F.col(f"{side}_item").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("_place").cast("string")))
    x = x.join(sound, doc).withColumn("_key", key("a")).select(doc, "_key", "a_item", "a_order")
    y = y.join(sound, doc).withColumn("_key", key("b")).select(doc, "_key", "b_item", "b_order")
    return x.join(y, [doc, "_key"], "full_outer").drop("_key")


def best_unique(pairs: DataFrame, key: str, candidate: str, score: str, least: float) -> DataFrame:
    """Per key the candidate of the highest score, if it reaches ``least`` and no other shares it; else null."""
    top = pairs.groupBy(key).agg(F.max(score).alias("_top"))
    best = pairs.join(top, key).where((F.col(score) == F.col("_top")) & (F.col("_top") >= least))
    one = best.groupBy(key).agg(F.count("*").alias("_n"), F.min(candidate).alias(candidate), F.max(score).alias(score)).where("_n = 1")
    return top.select(key).join(one.drop("_n"), key, "left")


def best_by_words(rows: DataFrame, group: str, key: str, text: str, least: float) -> DataFrame:
    """Per row of a group that has others the one other row (``evidence``) whose words overlap its own most (shared words
    over the smaller set), if that reaches ``least`` and no other shares it; else null.

    Rows of equal word sets are counted first, and different sets meet on the words they share, so pairs are of sets.
    """
    rows = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), key, F.array_sort(F.coalesce(words(text), F.array().cast("array<string>"))).alias("_w"))
    sets = rows.groupBy("_g", "_w").agg(F.count("*").alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    by_word = sets.select("_g", "_w", F.explode("_w").alias("_word"))
    met = by_word.join(by_word.withColumnRenamed("_w", "_x"), ["_g", "_word"]).where("_w != _x").groupBy("_g", "_w", "_x").agg(F.count("*").alias("_shared"))
    scored = met.select("_g", "_w", "_x", (F.col("_shared") / F.least(F.size("_w"), F.size("_x"))).alias("_s"))
    of = sets.select("_g", F.col("_w").alias("_x"), F.col("_n").alias("_m"), F.col("_lo").alias("_e"))
    tied = scored.join(of, ["_g", "_x"]).groupBy("_g", "_w", "_s").agg(F.sum("_m").alias("_m"), F.min("_e").alias("_e"))
    best = tied.groupBy("_g", "_w").agg(F.max(F.struct("_s", "_m", "_e")).alias("_b"))
    sizes = sets.groupBy("_g").agg(F.sum("_n").alias("_all")).where("_all > 1")
    known = rows.join(sets.join(sizes, "_g").join(best, ["_g", "_w"], "left"), ["_g", "_w"])
    alike = F.when(F.size("_w") > 0, F.col("_n") - 1).otherwise(0)  # others of the same words, which score 1
    from_others = F.coalesce(F.when(F.col("_b._s") == 1, F.col("_b._m")), F.lit(0))
    found = (
        F.when((alike == 1) & (from_others == 0), F.struct(F.when(F.col(key) == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("e"), F.lit(1.0).alias("s")))
        .when((alike == 0) & (F.col("_b._m") == 1) & (F.col("_b._s") >= least), F.struct(F.col("_b._e").alias("e"), F.col("_b._s").alias("s")))
    )
    return known.select(key, found.alias("_f")).select(key, F.col("_f.e").alias("evidence"), F.col("_f.s").alias("score"))


def grounded(args: DataFrame, records: DataFrame, key: str, record: str, name: str, value: str) -> DataFrame:
    """Per key whether every argument equals an approved value of some record, and of one and the same record.

    ``args`` has key, name, value; ``records`` record, name, value, at most one value a name. Records are cut to each set of
    names that arguments come in and meet whole argument lists on equality, so that a value of many records makes no pairs.
    """
    given = args.groupBy(key).agg(F.count("*").alias("n_args"), F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))).alias("_want"))
    known = records.where(F.col(name).isNotNull() & F.col(value).isNotNull())
    hits = args.join(known.select(name, value).distinct(), [name, value])
    loose = hits.select(key, name).distinct().groupBy(key).agg(F.count("*").alias("n_found"))
    wholes = known.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v")))).alias("_has")).select("_has").distinct()
    wholes = wholes.withColumn("_names", F.col("_has.n"))
    asked, held = given.select(F.col("_want.n").alias("_ask")).distinct(), wholes.select("_names").distinct()
    shapes = held.join(asked, F.size(F.array_except("_ask", "_names")) == 0)  # kinds of records by kinds of argument lists
    cut = wholes.join(shapes, "_names").select(F.filter("_has", lambda x: F.array_contains("_ask", x["n"])).alias("_want")).distinct()
    rows = given.join(loose, key, "left").join(cut.withColumn("_together", F.lit(True)), "_want", "left").fillna(0, ["n_found"])
    return rows.select(key, "n_args", (F.col("n_found") == F.col("n_args")).alias("every"), F.coalesce("_together", F.lit(False)).alias("together"))


def one_swap(a: Column, b: Column) -> Column:
    """Whether one text is the other with two neighbouring characters swapped."""
    n = F.length(a)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swapped = F.transform(places, lambda i: F.concat(F.left(a, i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)))
    return (n == F.length(b)) & (n > 1) & (a != b) & F.array_contains(swapped, b)


def scale_between(value: Column, fact: Column, tol: float = 1e-6) -> Column:
    """The power of ten among 3, 6 and 9 either way by which a value misses a fact; 0 if equal, null if by none."""
    out = F.lit(None).cast("int")
    for k in (9, 6, 3, -3, -6, -9, 0):
        out = F.when(F.abs(value - fact * 10.0**k) <= tol * F.abs(value), k).otherwise(out)
    return out


def read_date(raw: Column) -> Column:
    """struct(date, ambiguous) of the common ways to write a date; of two parts up to 12 the first is the month."""
    parts = lambda p, k: F.regexp_extract(raw, p, k).try_cast("int")
    slashed = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$"
    a, b, y = (parts(slashed, k) for k in (1, 2, 3))
    month, day = F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)
    text = F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    date = F.when(raw.rlike(slashed), F.try_to_date(text, "yyyy-MM-dd"))
    for pattern in ("yyyy-MM-dd", "yyyyMMdd", "d MMMM yyyy", "MMMM d, yyyy"):
        date = F.coalesce(date, F.try_to_date(raw, pattern))
    return F.struct(date.alias("date"), F.coalesce(raw.rlike(slashed) & (a <= 12) & (b <= 12) & (a != b), F.lit(False)).alias("ambiguous"))
