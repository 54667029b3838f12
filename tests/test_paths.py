"""Reads inside documents against plain Python over parsed JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillcheck.operators import paths

DOCS = ['{"a":{"b":[1,"x",{"c":null,"d":{"e":"deep"}}]},"d":2.5,"e":[],"f":true,"g":{}}', "[1", None, '"top"', "", "7", '[["a","b"],["c"]]', '{"k":"1","k ":"2"}']


def plain_leaves(value, path="$", key=None, depth=99):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in plain_leaves(v, f"{path}.{k}", k, depth - 1)] if depth else []
    if isinstance(value, list):
        return [x for n, v in enumerate(value) for x in plain_leaves(v, f"{path}[{n}]", key, depth - 1)] if depth else []
    return [] if value is None else [(path, key, value if isinstance(value, str) else json.dumps(value))]


def test_leaves_equal_a_walk(spark):
    frame = spark.createDataFrame(list(enumerate(DOCS)), "id int, j string")
    for depth in (0, 2, 4, None):
        got = sorted((r.id, r.path, r.key or "", r.value) for r in paths.leaves(frame, "j", ["id"], depth).collect())
        want = []
        for n, x in enumerate(DOCS):
            if x not in (None, "", "[1"):
                want += [(n, p, k or "", v) for p, k, v in plain_leaves(json.loads(x), depth=99 if depth is None else depth)]
        assert got == sorted(want)
    assert {r.kind for r in paths.leaves(frame, "j", ["id"]).collect()} == {"bigint", "string", "decimal", "boolean"}


def test_near_misses(spark):
    cases = [
        ('{"a":{"total":"5"}}', None), ('{"a":{"to​tal":"5"}}', "a.to​tal"), ('{"ａ ":{"total":5}}', "ａ .total"), ('{"a":{"Total":"5"}}', None), ('{"a":{"total ":""}}', None),
        ('{"a":{"total ":null}}', None), ('{"a":{"total":"1","total ":"2"}}', None), ('{"a":[1]}', None), ("[", None), (None, None), ("", None),
    ]
    rows = spark.createDataFrame([(n, j, w) for n, (j, w) in enumerate(cases)], "n int, j string, want string")
    for r in rows.withColumn("got", paths.near_miss(F.col("j"), "a.total")).collect():
        assert r.got == r.want, r


def test_each_and_shallowest(spark):
    rows = spark.createDataFrame([(1, '{"l":[{"q":1},{"q":"x"},{},{"q":3}]}'), (2, '{"l":5}'), (3, None), (4, '{"l":[]}')], "id int, j string")
    assert [r[0] for r in rows.orderBy("id").select(paths.each(F.col("j"), "l", "q", "long")).collect()] == [[1, None, None, 3], None, None, []]
    docs = [(1, '{"x":{"net":1},"y":{"amount":2}}'), (2, '{"net":1,"y":{"amount":2}}'), (3, '{"z":1}'), (4, '{"b":{"net":1},"a":{"Net ":2}}')]
    got = {r.id: (r.path, r.value) for r in paths.shallowest(spark.createDataFrame(docs, "id int, j string"), "j", ["id"], ["amount", "net"]).collect()}
    assert got == {1: ("$.y.amount", "2"), 2: ("$.net", "1"), 4: ("$.a.Net ", "2")}


def walk(value, steps=()):
    yield steps, value
    parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in parts:
        yield from walk(v, (*steps, k))


def plain_matches(value, pattern):
    """Values that a path of (step or "*" or "..") leads to."""
    found = [value]
    for step in pattern:
        if step == "..":
            found = [v for x in found for _, v in walk(x)]
        else:
            parts = [list(x.items()) if isinstance(x, dict) else list(enumerate(x)) if isinstance(x, list) else [] for x in found]
            found = [v for own in parts for k, v in own if step == "*" or (k == step and type(k) is type(step))]
    return found


def test_paths_at_any_depth(spark):
    deep = "5"
    for k in range(30):
        deep = f'{{"n{k}":{deep}}}' if k % 3 else f"[{deep}, 1]"
    docs = [*DOCS, deep, '{"a.b":{"x":1},"a":{"b":{"x":2}},"x":[{"x":[1,2]}]}', '{"q\\"}":[{"x":"a]\\"b"}]}', "{}", "[]"]
    patterns = {
        "$..x": ["..", "x"], "a.b[*]": ["a", "b", "*"], "$.a.*": ["a", "*"], "$..*": ["..", "*"], "$.a.b[0]": ["a", "b", 0], "$": [], "$['a.b'].x": ["a.b", "x"], "$[*][1]": ["*", 1],
        "$..b..x": ["..", "b", "..", "x"], "$.*.x": ["*", "x"], "$..n1": ["..", "n1"], "zzz": ["zzz"],
    }
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, j string")
    got = {(r.id, r.pattern): (r.n, r.value) for r in paths.path_matches(frame, "j", ["id"], list(patterns)).collect()}
    assert len(got) == len(docs) * len(patterns)
    for n, text in enumerate(docs):
        whole = text not in (None, "", "[1")
        for pattern, steps in patterns.items():
            # .. may reach a value by several ways; a path counts the values
            want = plain_matches(json.loads(text), steps) if whole else []
            want = list({id(v): v for v in want}.values()) if steps.count("..") > 1 else want
            count, value = got[n, pattern]
            assert count == len(want), (text, pattern)
            if count == 1:
                read = value if isinstance(want[0], str) else None if value is None else json.loads(value)
                assert read == want[0]
    found = paths.leaves(frame.where(f"id = {len(DOCS)}"), "j", ["id"]).collect()
    assert sorted(r.value for r in found) == ["1"] * 10 + ["5"]


def test_paths_refuse_scripts(spark):
    import pytest

    with pytest.raises(ValueError, match="not evaluated"):
        paths.path_matches(spark.createDataFrame([("{}",)], "j string"), "j", [], ["$.a[?(@.x)]"])


def test_documents_are_read_without_shuffles(spark, monkeypatch):
    monkeypatch.setattr(paths, "SLICE", 2)
    docs = ['{"k":1.50,"l":[1e2,-0,12345678901234567890,{"m":null}],"x":"\\ud800a\\u0001"} rest', ' {"l":{"é":"ü"}}', None, "[", '{"k":1,"k":2}', '{"l":[]}', '"t"'] * 3
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, j string")
    found = paths.path_matches(frame, "j", ["id"], ["$.l", "$..k", "$"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id % 7, r.pattern): (r.n, r.path, r.kind, r.value) for r in found.collect()}
    assert len(got) == 21 and got[1, "$.l"] == (1, "$.l", "object", '{"é":"ü"}') and got[2, "$"] == got[3, "$"] == got[4, "$..k"] == (0, None, None, None)
    assert got[0, "$..k"][:3] == (1, "$.k", "decimal") and got[5, "$.l"] == (1, "$.l", "array", "[]") and got[6, "$"] == (1, "$", "string", "t")
    deep = spark.createDataFrame([('{"a":' * 400 + "[1.50]" + "}" * 400,)], "j string")
    assert paths.path_matches(deep, "j", [], ["$.a", "$..a[0]"]).select("n", "kind").collect() == [(1, "object"), (1, "decimal")]
    rows = paths.leaves(frame, "j", ["id"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.kind) for r in rows.where("id = 0").collect()} == {("$.k", "decimal"), ("$.l[0]", "double"), ("$.l[1]", "bigint"), ("$.l[2]", "decimal"), ("$.x", "string")}
    texts = paths.leaves(frame, "j", ["id"], texts_only=True)
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(map(tuple, rows.where("kind = 'string'").collect()), key=str)
