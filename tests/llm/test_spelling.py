"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib

from quillcheck.llm import spelling

from . import corpus

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_words(rows):
    count = {}
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(count):
    words, form, n_near = sorted(count), {}, {}
    for w in words:
        found = [x for x in words if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], n_near[w], count[form[w]] if form[w] else None))
    return sorted(out)


def as_rows(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def test_groups_equal_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abéÿ", k=rng.randint(5, 8))): rng.choice([3, 4, 9, 20, 50]) for _ in range(700)}
    long = "".join(rng.choices("ab", k=3000))
    words |= {long: 40, long[:-1]: 3, long[:1500] + "c" + long[1501:]: 9, "aaaaa": 90, "aaaaaa": 30, "aaaaaaa": 10, "😀😀😀😀a": 8, "😀😀😀😀b": 3}
    rows = [*words.items(), (None, 5), ("nnnnn", None)]
    found = as_rows(spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")))
    assert found == brute(words)
    assert any(r[2] != r[0] and r[2] != r[1] for r in found)  # some chains are longer than one step


def test_report_equals_loops(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdeéÀÿ", k=rng.randint(3, 8))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice([w, w.upper(), w + "s"]) for w in rng.choices(vocabulary, k=200))) for k in range(60)]
    rows += [(None, "letters, letters; letters-letters"), (61, None), (62, ""), (63, "123 ..."), (1, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(k, t, "own", "own") for k, t in rows], "doc_id long, text string, word string, run string")
    assert as_rows(spelling.spelling_report(docs)) == brute(brute_words(rows))
    kept = spelling.printed_words(docs).count()
    assert kept == sum(len(re.findall("[A-Za-zÀ-ÿ]+", t or "")) for _, t in rows)


def test_one_shared_string_a_pair():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(200)})
    place, a, b = spelling.deletions(words)
    keys = {}
    for p, x, y in zip(place.tolist(), a.tolist(), b.tolist()):
        keys.setdefault((x, y), []).append(p)
    met = [(i, j) for x in keys.values() for i in x for j in x if i < j]
    strings = [{w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for w in words]
    assert len(keys) == len(set().union(*strings))
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            assert met.count((i, j)) == len(strings[i] & strings[j])
            assert not near(words[i], words[j]) or met.count((i, j)) == 1


def test_edges(spark):
    assert spelling.spelling_report(corpus.empty(spark)).count() == 0
    assert spelling.spelling_report(corpus.documents(spark)).count() == len(brute_words(list(enumerate(corpus.texts()))))
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert as_rows(spelling.spelling_groups(one)) == [("alone", None, "alone", 3, 0, None)]
