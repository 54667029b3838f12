"""Registers and logs as files: strict readers that refuse or set aside what they cannot read, and their writers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """A register with a header: all columns as text. Spark refuses the read at a row of the wrong width or a header of
    other names."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON objects by a declared schema, and the lines that are none, with their text."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", parsed.alias("r"))
    refused = rows.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).select("value")
    return rows.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("r.*").drop("_bad"), refused


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """An append-only log of JSON lines: its events, and what could not be read marked as torn tail (the unreadable end
    of a file without a line after it) or corruption."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", "file", "place", parsed.alias("r"))
    last = rows.groupBy("file").agg(F.max("place").alias("last"))
    bad = rows.where(F.col("r._bad").isNotNull()).join(last, "file")
    kind = F.when(F.col("place") == F.col("last"), "TORN_TAIL").otherwise("CORRUPT")
    return rows.where(F.col("r._bad").isNull()).select("r.*").drop("_bad"), bad.select("file", "value", kind.alias("kind"))


def write_log(events: DataFrame, path: str, order: str) -> None:
    """Events as JSON lines in order over all part files."""
    events.orderBy(order).select(F.to_json(F.struct(*events.columns)).alias("value")).write.text(path)


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    kinds = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpeg", "504B0304": "zip", "3C3F786D6C": "xml", "7B": "json", "5B": "json"}
    out = F.lit("text")
    for magic, kind in reversed(list(kinds.items())):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return F.when(content.isNull() | (F.length(content) == 0), "empty").otherwise(out)


class Refused(ValueError):
    pass


def _strict(text: str) -> object:
    """The value of a JSON text without repeated keys, inexact or infinite numbers, or depth over 256."""
    from decimal import Decimal

    def pairs(items: list[tuple[str, object]]) -> dict:
        seen = dict(items)
        if len(seen) != len(items):
            names = [k for k, _ in items]
            raise Refused(f"repeated key {next(k for k in names if names.count(k) > 1)}")
        return seen

    def number(token: str) -> float:
        value = float(token)
        if value in (float("inf"), float("-inf")) or Decimal(token) != Decimal(repr(value)):
            raise Refused(f"inexact number {token}")
        return value

    def whole(token: str) -> int:
        if abs(int(token)) > 2**53 - 1:
            raise Refused(f"inexact number {token}")
        return int(token)

    def constant(token: str):
        raise Refused(f"no number: {token}")

    value = json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_int=whole, parse_constant=constant)
    stack = [(value, 1)]
    while stack:
        x, depth = stack.pop()
        if depth > 256:
            raise Refused("too deep")
        stack += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return value


def canonical(value: object) -> str:
    """JSON text with sorted keys and no blanks; whole numbers without a point."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Each text's canonical form and hash, or why it is refused. Strictness about keys and numbers has no built-in."""
    schema = T.StructType([*[texts.schema[c] for c in keep], T.StructField("canonical", T.StringType()), T.StructField("refused", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            forms, reasons = [], []
            for x in rows[text]:
                try:
                    forms.append(canonical(_strict(x)))
                    reasons.append(None)
                except (ValueError, TypeError) as e:
                    forms.append(None)
                    reasons.append(str(e) if isinstance(e, Refused) else "not JSON")
            yield rows[keep].assign(canonical=forms, refused=reasons)

    return texts.select(*keep, text).mapInPandas(run, schema).withColumn("hash", F.sha2("canonical", 256))


def text_tables(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Cells of plain-text tables: a ``TABLE:`` line with the title, a ``COLUMNS:`` line, then rows of a label and cells
    between bars. One row per cell: document, title, scale, label, column, value.

    The title in force at a line is the last one before it, and likewise the columns. A title that says "in thousands"
    (millions, billions) scales its cells, unless it speaks of shares. Brackets mean negative.
    """
    from pyspark.sql import Window as W

    from ..functions.numbers import decimal_text

    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    text = F.trim(line)
    title = F.when(text.startswith("TABLE:"), F.trim(F.substr(text, F.lit(7))))
    names = F.when(text.startswith("COLUMNS:"), F.split(F.trim(F.substr(text, F.lit(9))), r"\s*\|\s*"))
    rows = lines.select(
        doc, order, text.alias("_t"), F.last(title, True).over(w).alias("title"), F.last(names, True).over(w).alias("_names")
    ).where(F.col("_t").contains("|") & ~F.col("_t").rlike("^(TABLE|COLUMNS):") & F.col("_names").isNotNull())
    parts = F.split("_t", r"\s*\|\s*")
    lower = F.lower("title")
    scale = F.when(lower.rlike("shares in (thousands|millions|billions)"), 1)
    for word, k in (("thousands", 10**3), ("millions", 10**6), ("billions", 10**9)):
        scale = scale.when(lower.rlike(f"in {word}"), k)
    cells = rows.select(
        doc, order, "title", scale.otherwise(1).alias("scale"), F.trim(F.element_at(parts, 1)).alias("label"), "_names",
        F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("_k", "cell"),
    )
    bare = F.regexp_replace("cell", r"[$\s]", "")
    value = decimal_text(bare).cast("double") * F.col("scale")
    return cells.select(doc, "title", "scale", "label", F.get("_names", F.col("_k")).alias("column"), "cell", value.alias("value"))
