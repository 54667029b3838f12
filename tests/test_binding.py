from __future__ import annotations

from pyspark.sql import functions as F

from quillcheck.operators import binding, markup


def test_bound_values_keep_their_status(spark):
    docs = ['{"a":1.5}', '{"b":{"c":"2"}}', '{"a":null,"b":{"c":3}}', '{"a":""}', "{}", None, '{"a":"UNREADABLE"}']
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, t string").select("id", F.try_parse_json("t").alias("d"))
    got = {r.id: tuple(r.b) for r in rows.select("id", binding.bind(F.col("d"), ["$.a", "$.b.c"], "double").alias("b")).collect()}
    assert got[0] == (1.5, "ok", "$.a") and got[1] == (2.0, "ok", "$.b.c")
    assert got[2][1] == got[3][1] == got[6][1] == "unparseable" and got[4] == (None, "missing", None) == got[5]
    text = {r.id: tuple(r.b) for r in rows.select("id", binding.bind(F.col("d"), ["$.a"], "string", "x").alias("b")).collect()}
    assert text[4] == ("x", "defaulted", None) and text[3][:2] == (None, "unparseable") and text[6][:2] == (None, "unparseable")


def test_swaps_and_scales(spark):
    rows = spark.createDataFrame([("1234", "1324"), ("1234", "1234"), ("12", "21"), ("1", "1"), ("", ""), ("1234", "4231"), (None, "1")], "a string, b string")
    assert [r.x for r in rows.select(binding.one_swap(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, False, False, False, None]
    pairs = spark.createDataFrame([(5.0, 5.0), (5000.0, 5.0), (5.0, 5e6), (7.0, 5.0), (None, 1.0)], "v double, f double")
    assert [r.x for r in pairs.select(binding.scale_between(F.col("v"), F.col("f")).alias("x")).collect()] == [0, 3, -6, None, None]


def test_dates(spark):
    rows = spark.createDataFrame([("2024-02-03",), ("02/03/2024",), ("13/02/2024",), ("31/02/2024",), ("3 February 2024",), ("soon",), (None,)], "t string")
    got = [(str(r.d.date) if r.d.date else None, r.d.ambiguous) for r in rows.select(binding.read_date(F.col("t")).alias("d")).collect()]
    assert got == [("2024-02-03", False), ("2024-02-03", True), ("2024-02-13", False), (None, False), ("2024-02-03", False), (None, False), (None, False)]


def test_grounding_needs_one_record(spark):
    args = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "z"), (3, "a", "q")], "k int, n string, v string")
    records = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y"), ("s", "b", "z")], "rec string, n string, v string")
    got = {r.k: (r.every, r.together) for r in binding.grounded(args, records, "k", "rec", "n", "v").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_text_and_markup(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(markup.done_claims(F.lit("It is done. It should be fixed soon. All tests pass!"))) == ["It is done.", "All tests pass!"]
    assert tuple(one(markup.run_counts(F.lit("1 failed, 2 passed\n3 passed")))) == (3, 1) and one(markup.run_counts(F.lit("nothing"))) is None
    assert one(markup.name_words(F.lit("readFile_now-v2"))) == ["read", "file", "now", "v2"]
    assert one(markup.equivalence(F.lit("$1,000.00"), F.lit("1000"), "amount")) == "equivalent"
    assert one(markup.equivalence(F.lit("02/03/2024"), F.lit("2024-02-03"), "date")) == "equivalent"
    assert one(markup.equivalence(F.lit("ten"), F.lit("10"), "amount")) is None
    html = '<ix:nonFraction name="n" contextRef="c" unitRef="u" sign="-" scale="3">(1,5)</ix:nonFraction><ix:nonFraction name="m" contextRef="c" scale="-2">12</ix:nonFraction>'
    rows = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "id int, h string")
    assert [(r.id, r.concept, r.value) for r in markup.numeric_facts(rows, ["id"], "h").collect()] == [(1, "n", None), (1, "m", 0.12)]
