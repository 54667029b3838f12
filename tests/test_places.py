"""Mapped texts against a walk by character, and places of quotations in the original."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from quillcheck.functions import places
from quillcheck.operators import quotes

SIGNS = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-"}


def walk(text):
    """Characters of the compared form, each with the places [start, end) of the original that it stands for."""
    out, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i] == "-":
            while j < len(text) and text[j] in " \t":
                j += 1
            if text[j : j + 1] == "\n" or text[j : j + 2] == "\r\n":
                while j < len(text) and text[j].isspace():
                    j += 1
                i = j
                continue
            j = i + 1
        if text[i].isspace():
            while j < len(text) and text[j].isspace():
                j += 1
            out.append((" ", i, j))
        elif text[i] == "\u2026":
            out += [(".", i, j)] * 3
        else:
            c = SIGNS.get(text[i], text[i])
            out.append((c.lower() if len(c.lower()) == 1 else c, i, j))
        i = j
    while out and out[0][0] == " " and out[0][1] == 0:
        out.pop(0)
    while out and out[-1][0] == " " and out[-1][2] == len(text):
        out.pop()
    return out


def test_mapping_and_spans(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB\u0130- \n\t\u2026\u201d.", k=rng.randint(0, 30))) for _ in range(150)] + [None, "", "  ", "-\n"]
    rows = []
    for n, text in enumerate(texts):
        chars = walk(text or "")
        assert text is None or places.mapped_text(text)[0] == "".join(c for c, *_ in chars)
        for _ in range(4 if chars else 0):
            a = rng.randrange(len(chars))
            b = rng.randint(a + 1, len(chars))
            if chars[a][0] != " " and chars[b - 1][0] != " ":  # quotations neither begin nor end with a blank
                rows.append((n, text, a, b - a, chars[a][1], chars[b - 1][2]))
    frame = spark.createDataFrame(rows, "n int, t string, a int, size int, start int, end int").withColumn("m", places.mapped("t"))
    for r in frame.withColumn("s", places.original_span(F.col("m"), F.col("a"), F.col("size"))).collect():
        assert (r.s.start, r.s.end) == (r.start, r.end), (r.t, r.a, r.size)
    assert spark.createDataFrame([(None,)], "t string").select(places.mapped("t").alias("m")).first().m.text is None


def test_quotations_at_their_places(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["one", "Two", "the", "fi\u2019ve", "six-ty", "x\u2026"]) for _ in range(n))
    asked = [(k, say(k % 9 + 1)) for k in range(25)] + [(50, None), (51, ""), (52, "fi've"), (53, "nowhere to be found at all")]
    docs = [(k, say(rng.randint(0, 9)) + rng.choice([" ", "\n\n", " -\n"]) + (asked[k % 25][1]).replace(" ", rng.choice(["  ", "\n"])).replace("tw", "t-\n w") + " " + say(3)) for k in range(40)] + [(90, None), (91, "")]
    monkeypatch.setattr(quotes, "BLOCK", 2)
    frames = spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(asked, "q int, text string")
    for few in (0, 1000):
        got = {(r.d, r.q): (r.place, r.start, r.end) for r in quotes.verbatim(*frames, "d", "q", few=few).collect()}
        want = {}
        for d, text in docs[:-2] + docs[-1:]:
            chars = walk(text or "")
            whole = "".join(c for c, *_ in chars)
            for q, said in asked[:25] + asked[26:]:
                said = "".join(c for c, *_ in walk(said or ""))
                at = whole.find(said)
                if not said:
                    want[d, q] = (1, chars[0][1], chars[0][1]) if chars else (1, 0, 0)
                elif at >= 0:
                    want[d, q] = (at + 1, chars[at][1], chars[at + len(said) - 1][2])
        assert got == want and len(want) > 60
    assert quotes.verbatim(frames[0], frames[1].limit(0), "d", "q").count() == 0


def test_plain_form_is_the_mapped_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("aBΣ-- \n\t\r\x1c\xa0 …”.", k=rng.randint(0, 14))) for _ in range(400)] + ["foo -\n", " -\nfoo", "--\n\nx", "ΟΔΟΣ", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", places.compared("t").alias("x"))
    assert {r.n: r.x for r in rows.collect()} == {n: places.mapped_text(x)[0] for n, x in enumerate(texts)}


def test_only_texts_with_a_quotation_are_mapped(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        @F.pandas_udf(places.MAPPED)
        def run(xs: pd.Series) -> pd.DataFrame:
            seen.add(len(xs))
            return pd.DataFrame([places.mapped_text(x) for x in xs], columns=["text", "at", "origin"])

        return run(F.col(x))

    monkeypatch.setattr(quotes, "mapped", counted)
    docs = spark.createDataFrame([(k, "the one that holds it here" if k == 7 else f"nothing of use in {k} at all") for k in range(200)], "d int, text string")
    asked = spark.createDataFrame([(1, "one that holds it"), (2, "holds it")], "q int, text string")
    assert sorted((r.d, r.q) for r in quotes.verbatim(docs, asked, "d", "q").collect()) == [(7, 1), (7, 2)]
    assert seen.value <= 2 * 2 + 2
