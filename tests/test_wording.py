"""Forms of texts, label lines, draws and orders of options against hand-worked or plain versions."""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import functions as F

from quillcheck.functions import text
from quillcheck.operators import ledger


def column(spark, texts, c):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").orderBy("k")
    return [r[0] for r in rows.select(c).collect()]


def test_forms(spark):
    texts = ["A-B  c_d!", " ＡÉ 1,2 ", "", None, "...", "ofﬁce so\xadft\xad\n hy-\n phen Up-\nPer “q” ‘s’ – e…"]
    assert column(spark, texts, text.description("x")) == ["ab c_d", "12", "", None, "", "ofce soft hy phen up per q s e"]
    assert column(spark, texts, text.canonical("x")) == ["A-B c_d!", "ＡÉ 1,2", "", None, "...", "office softhyphen Up- Per \"q\" 's' - e..."]


def test_label_lines(spark):
    labels = ("Total due", "tax")
    texts = ["x\nTAX 5\nTotal  due: 3", "Taxes 5", "tax and charges", "tax and 5 charges", "tax", "tax And", "\r\n total due", None, "", "Totaldue", "tax) x"]
    got = column(spark, texts, text.label_line("x", labels))
    assert [r and tuple(r) for r in got] == [
        (2, "tax", "TAX 5"), None, None, (1, "tax", "tax and 5 charges"), (1, "tax", "tax"), (1, "tax", "tax And"), (2, "total due", "total due"), None, None, None, (1, "tax", "tax) x"),
    ]
    assert column(spark, ["a\nb  12 c", "12", "1\n2", None], text.raw_line("x", F.lit(" 12"))) == [2, 1, None, None]
    assert column(spark, ["a 1", "b"], text.raw_line("x", F.lit("1"))) == [None, None]


def test_draws_and_orders(spark):
    refs = [f"r{k}" for k in range(40)] + ["r1", None]
    frame = spark.createDataFrame([(r,) for r in refs], "ref string")
    want = sorted({r for r in refs if r}, key=lambda r: hashlib.sha256(f"s:{r}".encode()).hexdigest())
    for k in (0, 7, 100):
        assert [r.ref for r in ledger.bottom_k(frame, "ref", "s", k).orderBy("rank").collect()] == want[:k]
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a"]), (4, []), (5, None)], "k int, o array<string>").orderBy("k")
    got = [r[0] for r in rows.select(ledger.schedules(F.col("o"), 5, F.lit("s"))).collect()]
    assert got[0][:2] == [["a", "b", "c"], ["c", "b", "a"]] and all(tuple(o) in set(permutations("abc")) for o in got[0]) and len({tuple(o) for o in got[0]}) == len(got[0])
    assert got[1] == [["a", "b"], ["b", "a"]] and got[2] == [["a"]] and got[3] == [[]]
