"""Word differences of quotations against full tables of words by words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import alignment
from quillcheck.functions.text import quotable
from quillcheck.operators import quotes


def shared(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(1, len(out) - 1)
        out[k : k + 1] = rng.choice([[], ["new"], [out[k], "more", "words"]])
    return out


@pytest.mark.parametrize("cells", [0, 12, 10_000])
def test_matching_is_valid_and_as_long_as_the_full_table(monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    rng = random.Random(cells)
    for n in range(150):
        p = [rng.choice("abcdefgh") + str(rng.randrange(1 if n % 2 else 60)) for _ in range(rng.randint(0, 60))]
        q = edited(rng, p, rng.randint(0, 6)) if len(p) > 20 else [rng.choice("abc") for _ in range(9)]
        found = alignment.matched(q, p)
        assert all(q[i] == p[j] for i, j in found) and all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
        assert len(found) <= shared(q, p)
        if cells > 100:
            assert len(found) >= shared(q, p) - (1 if len(p) * len(q) > cells else 0)
        rebuilt = list(q)
        lo = max(0, found[0][1] - found[0][0]) if found else 0
        hi = min(len(p), found[-1][1] + len(q) - found[-1][0]) if found else len(p)
        for i, j, said, stands in reversed(alignment.differences(q, p)):
            assert rebuilt[i - 1 : i - 1 + len(said)] == said and p[j - 1 : j - 1 + len(stands)] == stands
            rebuilt[i - 1 : i - 1 + len(said)] = stands
        assert rebuilt == p[lo:hi] or not q


def test_longest_run_of_the_automaton():
    rng = random.Random(2)
    for _ in range(300):
        q, p = (rng.choices("ab" if rng.random() < 0.5 else "abcd", k=rng.randint(0, 14)) for _ in "qp")
        want = min(((-n, i + 1, j + 1) for i in range(len(q)) for j in range(len(p)) for n in range(1, 15) if i + n <= len(q) and j + n <= len(p) and q[i : i + n] == p[j : j + n]), default=(0, 0, 0))
        n, i, j = alignment.Runs(q).longest(p)
        assert (-n, i, j) == want


def test_differences_by_hand(spark):
    docs = [
        (1, "Before. The court held that the claim, once filed, could not\nbe with-\ndrawn without leave of the court. After that, nothing."),
        (2, "testimony. That austere standard, as written, does not mean that the Rules themselves are a bar to it"),
        (3, None), (4, ""), (5, "a b c d e " * 2000),
    ]
    asked = [
        (1, "The court held that the claim, once filed, may not be withdrawn without leave of any court."),
        (2, "… testimony . . . and the Rules themselves are a bar to it"),
        (3, "the claim once filed could not be withdrawn without leave"),
        (4, None), (5, ""), (6, "A judge held that the claim once filed could be withdrawn"), (7, "a b c d e " * 300 + "f"),
    ]
    frames = spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(asked, "q int, text string")
    for few in (0, 1000):
        rows = quotes.differences(*frames, "d", "q", few=few).collect()
        got = {(r.d, r.q): (r.n_words, r.n_shared, [tuple(x) for x in r.differences]) for r in rows}
        assert got[1, 1] == (17, 15, [(9, 10, "may", "could"), (16, 17, "any", "the")])
        assert got[2, 2] == (10, 9, [(3, 10, "and", "that")])
        assert got[1, 3] == (10, 10, [])
        assert got[1, 6] == (11, 9, [(1, 2, "a judge", "the court"), (10, 11, "", "not")])
        assert got[5, 7][:2] == (1501, 1500) and [x[2] for x in got[5, 7][2]] == ["f"]
        assert len(got) == 5
    assert quotes.differences(frames[0].limit(0), frames[1], "d", "q").count() == 0


def test_on_tables(spark):
    """Items with words changed, in all documents of a small table: as many shared words as by the full table."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    asked = items.withColumn("text", F.regexp_replace("text", "[Tt]he ", "some "))
    rows = quotes.differences(docs, asked, "doc_id", "item_id").collect()
    bare = lambda rows, key: {r[0]: r.w for r in rows.select(key, F.split(quotes.bare_words(quotable("text")), " ").alias("w")).collect()}
    words, said = bare(docs, "doc_id"), bare(asked, "item_id")
    whole = 0
    for r in rows:
        p, q = words[r.doc_id], said[r.item_id]
        slack = max(3, -(-len(q) // 4))
        n, i, j = min(((-n, i, j) for n, i, j in [alignment.Runs(q).longest(p)]))
        near = p[max(0, j - i - slack) : j - i + len(q) + slack]
        assert (r.n_words, r.run, r.n_shared) == (len(q), -n, shared(q, near))
        whole += r.n_shared == r.n_words - sum(len(x.quoted.split()) for x in r.differences)
        for x in r.differences:
            assert q[x.quoted_at - 1 :][: len(x.quoted.split())] == x.quoted.split()
            assert p[x.place - 1 :][: len(x.stands.split())] == x.stands.split()
    assert whole == len(rows)


def test_texts_are_worked_out_once(spark):
    """Windows read a text's plain form once, and only documents in which a run is found are read again; blanks and signs as by Python."""
    rows = [(1, "Five words in a row"), (2, "two words"), (3, None), (4, ""), (5, "“One”  two\t\n three—four…\nfi-\nve \x0b six  seven '' eight 9% $10 ")]
    docs = spark.createDataFrame(rows, "d int, text string")
    found = quotes._windows(docs, "d", quotable("text"), "p", 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert sorted((r.d, r.p) for r in found.collect()) == [(1, 1), *((5, k) for k in range(1, 7))]
    plain = {r.d: r.t for r in docs.select("d", quotes.bare_words(quotable("text")).alias("t")).collect()}
    assert plain == {1: "five words in a row", 2: "two words", 3: None, 4: "", 5: "one two three-four five six seven eight 9% $10"}
