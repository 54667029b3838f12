"""Usage exports of model providers, as their public interfaces give them, read into one table of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Export:
    """A page's schema, the array of records in it (SQL over ``x``) and of results in a record (null: the record is the
    result), and what a row's values are, as SQL over the record ``r`` and the result ``u``."""

    schema: str
    records: str
    results: str | None
    values: dict[str, str]


_BUCKET = {"ids": "array()", "at": "null", "requests": "null"}
_REQUEST = {"start": "null", "end": "null", "requests": "1"}
#: The field names of the providers' published schemas.
EXPORTS = {
    "anthropic-usage-report": Export(
        "data array<struct<starting_at: string, ending_at: string, results: array<struct<model: string, uncached_input_tokens: long, cache_read_input_tokens: long, output_tokens: long, "
        "cache_creation: struct<ephemeral_1h_input_tokens: long, ephemeral_5m_input_tokens: long>>>>>",
        "x.data", "r.results",
        _BUCKET | {"start": "try_cast(r.starting_at as timestamp)", "end": "try_cast(r.ending_at as timestamp)", "model": "u.model", "output": "u.output_tokens",
                   "input": "u.uncached_input_tokens + coalesce(u.cache_read_input_tokens, 0) + coalesce(u.cache_creation.ephemeral_1h_input_tokens, 0) + coalesce(u.cache_creation.ephemeral_5m_input_tokens, 0)"},
    ),
    "openai-usage": Export(
        "data array<struct<start_time: long, end_time: long, results: array<struct<model: string, input_tokens: long, output_tokens: long, num_model_requests: long>>>>",
        "x.data", "r.results",
        _BUCKET | {"start": "timestamp_seconds(r.start_time)", "end": "timestamp_seconds(r.end_time)", "model": "u.model", "input": "u.input_tokens", "output": "u.output_tokens", "requests": "u.num_model_requests"},
    ),
    "openai-chat-completions": Export(
        "data array<struct<id: string, created: long, model: string, usage: struct<prompt_tokens: long, completion_tokens: long>>>", "x.data", None,
        _REQUEST | {"ids": "array(u.id)", "at": "timestamp_seconds(u.created)", "model": "u.model", "input": "u.usage.prompt_tokens", "output": "u.usage.completion_tokens"},
    ),
    "openai-responses": Export(
        "id string, created_at long, model string, usage struct<input_tokens: long, output_tokens: long>", "array(x)", None,
        _REQUEST | {"ids": "array(u.id)", "at": "timestamp_seconds(u.created_at)", "model": "u.model", "input": "u.usage.input_tokens", "output": "u.usage.output_tokens"},
    ),
    "openrouter-generations": Export(
        "data struct<id: string, upstream_id: string, created_at: string, model: string, tokens_prompt: long, tokens_completion: long>", "array(x.data)", None,
        _REQUEST | {"ids": "array_compact(array(u.id, u.upstream_id))", "at": "try_cast(u.created_at as timestamp)", "model": "u.model", "input": "u.tokens_prompt", "output": "u.tokens_completion"},
    ),
    "openrouter-activity": Export(
        "data array<struct<date: string, model: string, model_permaslug: string, prompt_tokens: long, completion_tokens: long, requests: long>>", "x.data", None,
        _BUCKET | {"start": "try_cast(u.date as timestamp)", "end": "try_cast(u.date as timestamp) + interval 1 day", "model": "u.model", "input": "u.prompt_tokens", "output": "u.completion_tokens", "requests": "u.requests"},
    ),
}
_TYPES = {"ids": "array<string>", "at": "timestamp", "start": "timestamp", "end": "timestamp", "model": "string", "input": "long", "output": "long", "requests": "long"}


def read(pages: DataFrame, text: str, export: str, keys: list[str]) -> DataFrame:
    """One row a result of each page (a JSON text): the keys, ``granularity`` (request, minute, hour or day), ids, at,
    start, end, model, input, output and requests, and ``refused``: why a row cannot be used. A page that is no JSON object
    of this form gives one refused row without values; unlisted fields are not read (message contents never are)."""
    e = EXPORTS[export]
    x = F.from_json(F.col(text), e.schema, {"mode": "PERMISSIVE"})
    rows = pages.select(F.struct(*keys).alias("_key"), x.alias("x"))
    rows = rows.select("_key", F.explode_outer(F.expr(e.records)).alias("r"))
    rows = rows.select("_key", "r", F.explode_outer(F.expr(e.results)).alias("u")) if e.results else rows.withColumn("u", F.col("r"))
    rows = rows.select("_key", F.col("u").isNotNull().alias("_read"), *[F.expr(e.values[n]).cast(c).alias(n) for n, c in _TYPES.items()])
    width = F.unix_timestamp("end") - F.unix_timestamp("start")
    per_request = e.values["start"] == "null"
    kind = F.lit("request") if per_request else F.when(width <= 60, "minute").when(width <= 3600, "hour").otherwise("day")
    time = F.col("at").isNull() if per_request else F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start"))
    refused = F.when(~F.col("_read"), "not of this form").when(time, "no time").when(F.col("input").isNull() | F.col("output").isNull(), "no tokens")
    return rows.select("_key.*", F.when(~time, kind).alias("granularity"), *_TYPES, refused.alias("refused"))
