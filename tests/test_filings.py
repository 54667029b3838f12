"""Filings by hand, and trees against walks."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from quillcheck.operators.trees import tree_places
from quillcheck.sources import filings

PAGE = """<html xmlns:ix="x"><xbrli:context id='c1'><xbrli:entity><xbrli:identifier scheme="s">077</xbrli:identifier><xbrli:segment>
<xbrldi:explicitMember dimension="us-gaap:Axis">a:One</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate>
<xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context><context id="c2"><entity><identifier>077</identifier></entity><period><instant>2024-03-31T00:00:00</instant></period></context>
<context id="c2"><entity><identifier>078</identifier></entity><period><instant>2024-06-30</instant></period></context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<unit id="eps"><divide><unitNumerator><measure> iso4217:USD </measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit>
<ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="usd" scale="6" decimals="-6" format="ixt:num-dot-decimal">$ 1,2<b>34</b>.5<ix:exclude>9</ix:exclude></ix:nonFraction>
<ix:nonFraction name="us-gaap:Loss" contextRef="c1" unitRef="usd" sign="-">(7)</ix:nonFraction><ix:nonFraction name="x:Eps" contextRef="c2" unitRef="eps" format="ixt:num-comma-decimal">1.000,25</ix:nonFraction>
<ix:nonFraction name="x:Nil" contextRef="c2" unitRef="usd" xsi:nil="true"></ix:nonFraction><ix:nonFraction name="x:Single" contextRef="c2" unitRef="usd"/>
<ix:nonFraction name="x:Lost" contextRef="c9" unitRef="usd">5</ix:nonFraction><ix:nonFraction name="x:Text" contextRef="c1" unitRef="usd">about 5</ix:nonFraction>
<ix:nonFraction name="x:Words" contextRef="c1" unitRef="none" format="ixt-sec:numwordsen">Twelve</ix:nonFraction><ix:nonFraction name="x:Dash" contextRef="c1" unitRef="usd" format="ixt:fixed-zero" sign="-">-</ix:nonFraction></html>"""

PRE = """<link:linkbase><link:roleType roleURI="http://r/1"><link:definition>01 - Statement - BALANCE</link:definition></link:roleType>
<link:roleType roleURI="http://r/2"><link:definition>02 - Statement - BALANCE (Parenthetical)</link:definition></link:roleType>
<link:presentationLink xlink:role="http://r/0"/><link:presentationLink xlink:type="extended" xlink:role="http://r/1">
<link:loc xlink:href="http://f/us-gaap.xsd#us-gaap_Top" xlink:label="t"/><link:loc xlink:href="http://f/us-gaap.xsd#us-gaap_Revenues" xlink:label="r"/><link:loc xlink:href='o.xsd#x_Eps_Two' xlink:label='e'/>
<link:presentationArc xlink:from="t" xlink:to="r" order="1"/><link:presentationArc xlink:from="r" xlink:to="e" order="1"/></link:presentationLink>
<link:presentationLink xlink:role="http://r/2"><link:loc xlink:href="http://f/us-gaap.xsd#us-gaap_Revenues" xlink:label="r"/></link:presentationLink></link:linkbase>"""


def test_facts_carry_period_and_unit(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (None, PAGE)], "id int, html string")
    rows = filings.facts(pages, ["id"], "html").collect()
    for key in (1, None):
        got = {r.concept: r for r in rows if r.id == key}
        assert {c: (r.value, r.problem) for c, r in got.items()} == {
            "us-gaap:Revenues": (1234.5e6, None), "us-gaap:Loss": (-7.0, None), "x:Eps": (1000.25, None), "x:Nil": (None, "nil"), "x:Single": (None, "nil"),
            "x:Lost": (None, "no context"), "x:Text": (None, "no number"), "x:Words": (12.0, None), "x:Dash": (0.0, None),
        }
        r = got["us-gaap:Revenues"]
        assert (r.entity, r.instant, r.start, r.end, r.members, r.measures, r.per) == ("077", None, datetime.date(2024, 1, 1), datetime.date(2024, 3, 31), ["us-gaap:Axis=a:One"], ["iso4217:USD"], [])
        r = got["x:Eps"]
        assert (r.entity, r.instant, r.members, r.measures, r.per) == ("078", datetime.date(2024, 6, 30), [], ["iso4217:USD"], ["shares"])
        assert got["x:Words"].measures is None
    assert {r.id for r in rows} == {1, None}


def test_roles_of_concepts(spark):
    files = spark.createDataFrame([(1, PRE), (2, None), (3, "<a/>")], "id int, xml string")
    places = filings.presented(files, ["id"], "xml")
    got = {(r.role[-1], r.label): (r.concept, r.parent, r.root, r.depth, r.statement) for r in places.collect()}
    assert got == {
        ("1", "t"): ("us-gaap:Top", None, "t", 0, True), ("1", "r"): ("us-gaap:Revenues", "t", "t", 1, True),
        ("1", "e"): ("x:Eps_Two", "r", "t", 2, True), ("2", "r"): ("us-gaap:Revenues", None, "r", 0, False),
    }
    facts = filings.facts(spark.createDataFrame([(1, PAGE)], "id int, html string"), ["id"], "html")
    stated = {r.concept: (r.roles, r.statements, r.depth) for r in filings.stated_facts(facts, places, ["id"]).collect()}
    assert stated["us-gaap:Revenues"] == (["http://r/1", "http://r/2"], ["http://r/1"], 0) and stated["x:Text"] == ([], [], None)


def test_trees_equal_walks(spark):
    rng = random.Random(4)
    rows = [(k % 3 or None, n, rng.randrange(n) if n and rng.random() < 0.95 else None) for k in range(3) for n in range(60)]
    rows += [(5, n, n - 1) for n in range(1, 130)] + [(7, 1, 2), (7, 2, 3), (7, 3, 1), (7, 4, 3), (7, 5, None), (7, 6, 5), (7, 8, 8), (7, None, 1), (9, 1, None), (9, 1, 4), (9, 4, None)]
    up = {}
    for t, n, p in rows:
        if n is not None:
            up[t, n] = min((x for x in (p, up.get((t, n))) if x is not None), default=None)

    def walk(t, n):
        top, d, seen = n, 0, set()
        while (p := up[t, top]) is not None and (t, p) in up:
            if top in seen:
                return None, None
            seen.add(top)
            top, d = p, d + 1
        return top, d

    frame = spark.createDataFrame(rows, "t int, n int, p int")
    got = {(r.t, r.n): (r.root, r.depth) for r in tree_places(frame, ["t"], "n", "p").collect()}
    assert got == {k: walk(*k) for k in up}
    assert tree_places(frame.where(F.lit(False)), ["t"], "n", "p").count() == 0


def test_attributes_of_a_fact_are_read_once(spark):
    rows = spark.createDataFrame([(1, '<ix:nonFraction name="a" format="ixt:num-dot-decimal" scale="3" sign="-">(1,500)</ix:nonFraction>')], "k int, html string")
    read = filings.facts(rows, ["k"], "html")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("format\\s*=") <= 4  # in either quotes, and whether it is empty
    assert [(r.concept, r.value, r.problem) for r in read.collect()] == [("a", None, "no context")]
