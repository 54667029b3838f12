"""Decontamination against plain loops over words."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from quillcheck.llm import decontaminate as dc

from . import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window=10):
    wanted = {}
    for name, text in items:
        w = words(text)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(name)
    sizes = {len(x) for x in wanted}
    out = []
    for k, text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                names = wanted.get(tuple(w[p : p + n]))
                if names:
                    hit |= set(range(p, p + n))
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(seed=3, n=80):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "Été", "日本", "x1", "Zed", "of", "and", "it"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 10, 11, 25, 60])))) for k in range(12)]
    items += [(None, "quite alone here"), (12, ""), (13, None), (14, "..."), (15, items[3][1]), (15, items[4][1]), (16, "a " * 40)]
    texts = [(None, items[5][1]), (None, None), (1, None), (1, ""), (2, "-- " + items[6][1].upper() + "!"), (3, "quite, alone; here")]
    for k in range(4, n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice([rng.choice(items)[1] or "", " ".join(rng.choices(vocabulary, k=30)), "unknown words here"]))
        texts.append((k, "\n".join(parts)))
    texts += [(n, "the " * 30000), (n + 1, " ".join(rng.choices(vocabulary, k=20000))), (n + 1, texts[-1][1])]
    return texts, items


def frames(spark, texts, items):
    docs = spark.createDataFrame([(k, t, "own", "own") for k, t in texts], "doc_id long, text string, items string, _k string")
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [dc.BLOCK, 60])
def test_report_equals_loops(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "AUTOMATA", 2)
    texts, items = made()
    found = dc.contamination_report(*frames(spark, texts, items), block=block).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(texts, items)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "LONG", 300)
    texts, items = made(5, 20)
    docs, bench = frames(spark, texts, items)
    found = dc.contamination(docs, bench)
    machine = next(iter(dc.automata(bench).collect()))
    assert machine.built
    report = dc.contamination_report(docs, bench).collect()  # in this process LONG counts for none of the workers
    assert sorted((tuple(r) for r in report), key=repr) == brute(texts, items)
    for hashes, text, start, end, again in dc._words(np.frombuffer(b"one two three " * 100, np.uint8), np.array([0, 1400]), 9):
        assert len(hashes) == len(start) == len(end) and again in (0, 9)
    pieces = list(dc._words(np.frombuffer(b"one two three " * 100, np.uint8), np.array([0, 1400]), 9))
    assert len(pieces) > 1 and sum(len(x[0]) - x[4] for x in pieces) == 300
    assert found.columns == ["doc_id", "key", "n_words", "n_hit", "items", "spans"]


def test_scan_of_one_long_text_equals_short_blocks(monkeypatch):
    import pyarrow as pa

    texts, items = made(7, 30)
    coded = [np.concatenate([x[0] for x in dc._words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), 0)]) for _, t in items]
    machine = dc.Automaton([str(k) for k, _ in items], coded, 10)
    for _, text in texts[-8:]:
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["id", "key", "text"])
        monkeypatch.setattr(dc, "LONG", 4 << 20)
        whole = next(dc._scan(iter([batch]), [machine], 9)).to_pylist()
        monkeypatch.setattr(dc, "LONG", 200)
        assert next(dc._scan(iter([batch]), [machine], 9)).to_pylist() == whole


def test_removal(spark):
    item = "One two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Before é, {item}! after it all comes much more than that of text that nobody has seen anywhere", "x"), (2, item, "x"), (3, None, "x"), (None, "clean", "x")],
        "doc_id long, text string, _goes string",
    )
    bench = spark.createDataFrame([("q", item.upper())], "item_id string, text string")
    for few in (10, 0):
        out = {r.doc_id: r.text for r in dc.decontaminated_documents(docs, bench, few=few).collect()}
        assert out == {1: "Before é, ! after it all comes much more than that of text that nobody has seen anywhere", 3: None, None: "clean"}
    kept = dc.decontaminated_documents(docs, bench, length=12, coverage=1.0)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_tables(spark):
    docs, bench = frames(spark, [(1, "a b"), (2, None)], [(1, "a")])
    assert dc.contamination_report(docs.limit(0), bench).count() == 0
    rows = dc.contamination_report(docs, bench.limit(0)).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in sorted(rows)] == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert dc.contamination_report(corpus.documents(spark), bench).count() == len(corpus.texts())
