"""Reads inside JSON documents: keys that nearly match, values of list elements, texts at any place, deep keys."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_INVISIBLE = r"[\p{Z}\p{Cf}\s]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))


def fold_key(key: Column) -> Column:
    """A key without blanks and invisible characters, full-width characters as ASCII."""
    return F.regexp_replace(F.translate(key, _WIDE, _PLAIN), _INVISIBLE, "")


def near_miss(doc: Column, path: str) -> Column:
    """A dotted path as the document writes it, where its keys are found only after folding; null if it is there as given, or
    nowhere, or leads to null or empty text. List elements are not entered."""
    at, written, missed = doc, F.array().cast("array<string>"), F.lit(False)
    for part in path.split("."):
        entries = F.from_json(at, "map<string,string>")
        exact = F.map_contains_key(entries, F.lit(part))
        keys = F.map_keys(entries)
        place = F.array_position(F.transform(keys, fold_key), part).cast("int")
        key = F.when(exact, F.lit(part)).when(place > 0, F.get(keys, place - 1))
        at, written, missed = F.try_element_at(entries, key), F.array_append(written, key), missed | ~F.coalesce(exact, F.lit(False))
    return F.when(missed & (at != ""), F.array_join(written, "."))


def each(doc: Column, array: str, field: str, kind: str) -> Column:
    """One field of every element of a list (null where it is missing or does not read as ``kind``); null if there is no list."""
    elements = F.try_variant_get(F.try_parse_json(doc), f"$.{array}", "array<variant>")
    return F.transform(elements, lambda v: F.try_variant_get(v, f"$.{field}", kind))


#: Documents that are read between two record batches.
SLICE = 1000
_KEY, _PLACE = "\x01", "\x02"


class _Number(str):
    """A number as the document writes it."""


_READER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, strict=False)


def _read(doc: str):
    """The value of a JSON text that Spark reads: the first one in it, numbers as written."""
    value, _ = _READER.raw_decode(doc, len(doc) - len(doc.lstrip(" \t\r\n")))
    return value


def _json(value) -> str:
    """A value of any depth as JSON again, numbers as they were written."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            parts = [p for k, v in x.items() for p in (_Number(f",{json.dumps(k)}:"), v)]
        elif isinstance(x, list):
            parts = [p for v in x for p in (_Number(","), v)]
        else:
            out.append(x if isinstance(x, _Number) else json.dumps(x))
            continue
        signs = "{}" if isinstance(x, dict) else "[]"
        parts[:1] = [_Number(signs[0] + p[1:]) for p in parts[:1]] or [_Number(signs[0])]
        todo += [_Number(signs[1]), *reversed(parts)]
    return "".join(out)


def _walk(doc: str, depth: int | None):
    """Each value of a document, itself first: ``path``, ``code`` (the steps, each marked as key or place), the nearest name, and
    the value. Lists and objects at the depth are not opened."""
    todo = [("$", "", None, _read(doc), 0)]
    while todo:
        path, code, key, value, level = todo.pop()
        yield path, code, key, value
        if level == depth:
            continue
        if isinstance(value, dict):
            todo += [(f"{path}.{k}", f"{code}{_KEY}{k if k.isprintable() else k.replace(_KEY, '').replace(_PLACE, '')}", k, v, level + 1) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(f"{path}[{n}]", f"{code}{_PLACE}{n}", key, v, level + 1) for n, v in enumerate(value)]


def _told(value) -> tuple[str | None, str | None]:
    """A value as (text, JSON), one of them null: strings are texts."""
    return (value, None) if type(value) is str else (None, value if type(value) is _Number else _json(value))


def _per_document(docs: DataFrame, doc: str, keep: list[str], found, schema: str) -> DataFrame:
    """For each document the rows of ``found(text)``, beside its ``keep`` columns and with strings ``text`` and ``json`` last; read in Arrow batches, SLICE documents
    at a time. Documents that do not parse come as null."""
    rows = docs.select(*keep, F.when(F.try_parse_json(doc).isNotNull(), F.col(doc)).alias("_doc"))
    out = f"{schema}, text string, json string"
    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)

    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                at, got = [], []
                for n, text in enumerate(part.column(len(keep)).to_pylist()):
                    each = found(text)
                    got += each
                    at += [n] * len(each)
                columns = zip(*got) if got else [[] for _ in fields]
                kept = [part.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
                made = [pa.array(_plain(list(c)) if pa.types.is_string(f.type) else list(c), f.type) for c, f in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*part.schema.names[: len(keep)], *fields.names])

    kept = rows.drop("_doc").schema
    found_rows = rows.mapInArrow(read, StructType([*kept.fields, *docs.sparkSession.createDataFrame([], out).schema.fields]))
    value = F.try_parse_json("json")
    kind = F.when(F.col("text").isNotNull(), "string").otherwise(F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)))
    kind = F.when(F.col("json").rlike("^-?[0-9]+$") & (F.length("json") < 18), "bigint").otherwise(kind)
    return found_rows.withColumns({"kind": kind, "value": F.coalesce("text", F.try_variant_get(value, "$", "string"))}).drop("text", "json")


def _plain(texts: list) -> list:
    """Texts that can be written as UTF-8: half a surrogate pair is a question mark, as in Java."""
    return [x if x is None or x.isascii() else x.encode("utf-8", "replace").decode() for x in texts]


def leaves(docs: DataFrame, doc: str, keep: list[str], depth: int | None = None, texts_only: bool = False) -> DataFrame:
    """Every value (with ``texts_only`` every string), or those at most ``depth`` keys or places deep: ``path``, ``key`` (the nearest name above it), ``kind``,
    ``value`` (as text).

    Each document is read once, whatever its depth, and no document is shuffled. Documents that do not parse, empty lists,
    empty objects and JSON nulls give no row.
    """

    def found(text: str | None) -> list[tuple]:
        own = _walk(text, depth) if text is not None else ()
        if texts_only:
            return [(path, key, value, None) for path, _, key, value in own if type(value) is str]
        return [(path, key, *_told(value)) for path, _, key, value in own if value is not None and not isinstance(value, (dict, list))]

    return _per_document(docs, doc, keep, found, "path string, key string").select(*keep, "path", "key", "kind", "value")


def _steps(pattern: str) -> tuple[str | None, str]:
    """A path's last name, if all that follows it are places, and the expression that its codes match."""
    if re.search(r"\[[?(]", pattern):
        raise ValueError(f"filters and scripts are not evaluated: {pattern}")
    text = pattern if pattern.startswith("$") else f"$.{pattern}"
    any_step, out, name = f"[{_KEY}{_PLACE}][^{_KEY}{_PLACE}]*", "", None
    for deep, star, place, quoted, plain in re.findall(r"(\.\.)|(\[\*\]|\*)|\[(\d+)\]|\['([^']*)'\]|([^.\[\]*$]+)", text):
        if deep:
            out += f"({any_step})*"
        elif star:
            out, name = out + f"({any_step})", None
        elif place:
            out += _PLACE + place
        else:
            out, name = out + _KEY + re.escape(quoted or plain), quoted or plain
    return name, f"^{out}$"


def path_matches(docs: DataFrame, doc: str, keep: list[str], patterns: list[str]) -> DataFrame:
    """Per document and path: ``n``, how many values it leads to, and of a single one its ``path``, ``kind`` and ``value``.

    Paths have names, places ([0]), wildcards (* and [*], for every part of an object or list) and .. for any depth;
    without $ they start at the root. Filters and scripts raise an error. A document is read once for all paths, and what it
    gives is a row a path. Documents that do not parse have no values. ``keep`` columns stand beside.
    """
    table = tuple(map(_steps, patterns))

    def found(text: str | None) -> list[tuple]:
        counts, single = [0] * len(patterns), [(None, None)] * len(patterns)
        for path, code, key, value in _walk(text, None) if text is not None else ():
            for k in _matching(code, key, table):
                counts[k] += 1
                single[k] = (path, value)
        return [(p, n, path, *_told(value)) if n == 1 else (p, n, None, None, None) for p, n, (path, value) in zip(patterns, counts, single)]

    rows = _per_document(docs, doc, keep, found, "pattern string, n bigint, path string")
    one = lambda c: F.when(F.col("n") == 1, F.col(c)).alias(c)
    return rows.select(*keep, "pattern", "n", *[one(c) for c in ("path", "kind", "value")])


@lru_cache(maxsize=100_000)
def _matching(code: str, key: str | None, table: tuple[tuple[str | None, str], ...]) -> tuple[int, ...]:
    """Which paths lead to the place that a code names; documents have many places in common."""
    return tuple(k for k, (name, like) in enumerate(table) if (name is None or name == key) and re.fullmatch(like, code))


def shallowest(docs: DataFrame, doc: str, keep: list[str], aliases: list[str], depth: int | None = None) -> DataFrame:
    """The value of the first of some names at the least depth, in documents that have one: ``path``, ``value``.

    Names are compared folded and in lower case; at one depth the earlier alias wins, then the smaller path.
    """
    name = F.lower(fold_key(F.col("key")))
    rank = F.array_position(F.array(*map(F.lit, aliases)), name)
    steps = F.length(F.regexp_replace("path", r"[^.\[]", ""))
    rows = leaves(docs, doc, keep, depth).where(name.isin(aliases))
    best = rows.groupBy(*keep).agg(F.min(F.struct(steps.alias("steps"), rank.alias("rank"), "path", "value")).alias("best"))
    return best.select(*keep, "best.path", "best.value")
