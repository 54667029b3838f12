"""Each provider's page, read by hand-made examples."""

from __future__ import annotations

import json

import pytest

from quillcheck.sources import exports

_USE = {"start_time": 0, "end_time": 60, "results": [{"model": "m", "input_tokens": 3, "output_tokens": 4, "num_model_requests": 2, "new": 1}]}
_REPORT = {"starting_at": "1970-01-01T00:00:00Z", "ending_at": "1970-01-02T00:00:00Z", "results": [{"model": "m", "uncached_input_tokens": 1, "cache_read_input_tokens": 1, "cache_creation": {"ephemeral_5m_input_tokens": 1}, "output_tokens": 4}]}
PAGES = {
    "anthropic-usage-report": ({"data": [_REPORT]}, "day", []), "openai-usage": ({"data": [_USE]}, "minute", []),
    "openai-chat-completions": ({"data": [{"id": "a", "created": 0, "model": "m", "usage": {"prompt_tokens": 3, "completion_tokens": 4}}]}, "request", ["a"]),
    "openai-responses": ({"id": "a", "created_at": 0, "model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}}, "request", ["a"]),
    "openrouter-generations": ({"data": {"id": "a", "upstream_id": "b", "created_at": "1970-01-01T00:00:00Z", "model": "m", "tokens_prompt": 3, "tokens_completion": 4}}, "request", ["a", "b"]),
    "openrouter-activity": ({"data": [{"date": "1970-01-01", "model": "m", "prompt_tokens": 3, "completion_tokens": 4, "requests": 2}]}, "day", []),
}


@pytest.mark.parametrize("name", sorted(exports.EXPORTS))
def test_pages_are_read(spark, name):
    page, granularity, ids = PAGES[name]
    bad = json.dumps(page).replace("3", "null").replace('"uncached_input_tokens": 1', '"uncached_input_tokens": null')
    rows = spark.createDataFrame([(1, json.dumps(page)), (2, "no json"), (3, bad), (4, None)], "at int, page string").withColumnRenamed("at", "id")
    got = {r.id: r for r in exports.read(rows, "page", name, ["id"]).collect()}
    assert (got[1].granularity, got[1].ids, got[1].model, got[1].input, got[1].output, got[1].refused) == (granularity, ids, "m", 3, 4, None)
    assert got[3].refused == "no tokens" and got[2].refused and got[4].refused
    assert exports.read(rows.limit(0), "page", name, ["id"]).count() == 0
