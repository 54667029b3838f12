"""Names in free texts against plain loops."""

from __future__ import annotations

import random
import re

from quillcheck.operators import named


def spoken(x):
    x = re.sub("[.,'’]", "", x.lower().replace("&", " and "))
    return " ".join(re.findall(r"[^\W_]+", x))


def test_names_equal_loops(spark):
    rng = random.Random(4)
    words = ["supply", "north", "acme", "of", "élan", "7"]
    say = lambda n: rng.choice([" ", " - ", ". "]).join(rng.choices(words, k=n))
    names = [(k, say(rng.randint(1, 4)).upper()) for k in range(30)] + [(90, None), (91, "..."), (92, "A & B, Inc."), (93, "Ａcme")]
    texts = [(k, say(rng.randint(0, 9))) for k in range(60)] + [(70, None), (71, ""), (72, "bill of a and b inc"), (73, "acmes")]
    frames = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(names, "n int, name string")
    want = {}
    for t, text in texts:
        for n, name in names:
            if text and name and (phrase := spoken(name.replace("Ａ", "A"))):
                said = f" {spoken(text)} "
                at = said.find(f" {phrase} ")
                if at >= 0:
                    want[t, n] = len(said[:at].split()) + 1
    for few in (0, 1000):
        found = named.names_in_texts(*frames, "t", "n", few=few)
        assert {(r.t, r.n): r.place for r in found.collect()} == want
    got = {r.t: (r.n_named, r.n, r.reading) for r in named.named_vendor(frames[0], found, "t", "n").collect()}
    assert len(got) == len(texts) and got[72] == (1, 92, "named") and got[73] == (0, None, "none")
    for t, (count, one, _) in got.items():
        own = [n for x, n in want if x == t]
        assert count == len(own) and one == (own[0] if len(own) == 1 else None)
    assert named.names_in_texts(frames[0], frames[1].limit(0), "t", "n").count() == 0


def test_equal_names_are_sought_once(spark):
    """A name that many rows have gives a text one row, and counts as all of them; with and without, texts read the same."""
    names = [(k, "Acme, Inc." if k % 2 else "ACME INC") for k in range(40)] + [(50, "North Supply"), (51, None), (52, "...")]
    texts = [(1, "From acme inc"), (2, "to North Supply"), (3, "Acme Inc for North-Supply"), (4, "nobody"), (5, None)]
    texts, names = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(names, "n int, name string")
    once = named.names_once(names, "n")
    assert {(r.n, r.n_same) for r in once.collect()} == {(0, 40), (50, 1)}
    found = named.names_in_texts(texts, once, "t", "n")
    assert sorted((r.t, r.n, r.place) for r in found.collect()) == [(1, 0, 2), (2, 50, 2), (3, 0, 1), (3, 50, 4)]
    short = named.named_vendor(texts, found.join(once.select("n", "n_same"), "n"), "t", "n", "n_same").collect()
    assert sorted(short) == sorted(named.named_vendor(texts, named.names_in_texts(texts, names, "t", "n"), "t", "n").collect())
    assert {r.t: (r.n_named, r.n, r.reading) for r in short} == {1: (40, None, "several"), 2: (1, 50, "named"), 3: (41, None, "several"), 4: (0, None, "none"), 5: (0, None, "none")}
