"""Signs of mined rules over lines and cases, against loops, and how often cases are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillcheck.operators import grammar
from quillcheck.operators.grammar import Field


def test_rules_travel_as_bits_and_cases_are_read_once(spark):
    cases = spark.createDataFrame([(k, float(k), k % 3 == 0) for k in range(40)], "id int, total double, held boolean")
    lines = spark.createDataFrame([(k, float(k % 7), None if k % 5 == 0 else 3.0) for k in range(35)], "id int, q double, r double")
    fields, grid = {"q": Field("qty", source="a"), "r": Field("qty", source="b")}, tuple(n / 20 for n in range(40))  # more tolerances than a long has bits
    found = grammar.candidates(fields, {"total": Field("money", "total", "a")}, grid, (("total", "<=", 8.0),))
    seen = spark.sparkContext.accumulator(0)

    def noted(rows):
        for r in rows:
            seen.add(1)
            yield r

    cases = spark.createDataFrame(cases.rdd.mapPartitions(noted), cases.schema)
    flagged = grammar.flags(cases, lines, "id", F.col("held"), found, fields)
    tried = [(c, t) for c in found for t in c.grid]
    for r in flagged.collect():
        for (c, t), sign in zip(tried, r.flags, strict=True):
            q, s = float(r.id % 7), None if r.id % 5 == 0 else 3.0
            left, right = (q, s) if c.left == "q" else (s, q)
            known = r.id < 35 and s is not None
            want = r.id > 8 if c.family == "C" else None if not known else abs(q - s) > 1e-9 if c.family == "L2" else left > right * (1 + t) + 1e-9
            assert sign == ("?" if want is None else "1" if want else "0"), (r, c.rule, t)
    exchanged = [x for x in flagged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(exchanged) == 1 and "bool_or" not in exchanged[0] and exchanged[0].count("bit_or") <= 8  # six longs, whatever the number of rules
    seen.value = 0
    assert grammar.report(grammar.patterns(flagged), found, 0.4).count() == len(found)
    assert seen.value == 40
