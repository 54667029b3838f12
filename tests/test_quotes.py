from __future__ import annotations

from types import SimpleNamespace

from quillcheck.plans import quotes as quotes_plan
from quillcheck.plans import reconcile


def test_short_quotations_are_found(spark):
    texts = ["The  quick brown fox jumps over the lazy dog today", "quickest brownish fox", "a b c d e f g h", "fox", "", None, "nothing here", "over the lazy dogs sleep all day"]
    quotes = ["fox", "brown fox", "ick brown fo", "the lazy", "over the lazy dog", "b c d e f g", "b c d e f", "a b c d e f g h", "quick brown fox jumps over the l", "absent", "e lazy dog t", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string")
    plain = lambda x: " ".join(x.split()).lower()
    want = {(i, j, plain(x).index(plain(q)) + 1) for i, x in enumerate(texts) for j, q in enumerate(quotes) if x is not None and q is not None and plain(q) in plain(x)}
    got = [tuple(r) for r in reconcile.quote_verbatim(SimpleNamespace(documents=docs, benchmark=bench)).select("doc_id", "item_id", "place").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_places_stand_as_laid_out(spark):
    texts = ["Said THE heat, then more words follow here", "said the heat, then more words follow here", "a b,  c d e f g h", "a b, c d e f g h", "x one two three four five six-\nseven", "ΟΔΟΣΑ is a word", "", None, "one two three four… five"]
    quotes = ["the heat, then more words follow", "b, c d e f g", "one two three four five six-", "ΟΔΟΣ", "", None, "-", "four... five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string")
    laid = lambda x: x.replace(", ", ",\n   ").replace("th", "t-\nh")
    low = lambda x: x.replace("Σ", "σ").lower()
    want = set()
    for i, x in enumerate(texts):
        for j, q in enumerate(quotes):
            if x is not None and q and low(laid(q)) in low(laid(x)):
                at = low(laid(x)).index(low(laid(q)))
                want.add((i, j, at, at + len(laid(q)), laid(x)[at : at + len(laid(q))]))
    got = [tuple(r) for r in quotes_plan.quote_places(SimpleNamespace(documents=docs, benchmark=bench)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[:2] for r in want} >= {(1, 0), (3, 1), (4, 2), (5, 3)}
