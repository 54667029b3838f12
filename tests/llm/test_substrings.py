from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillcheck.llm import substrings

from .corpus import documents, empty, texts


def brute(values: list[str | None], length: int = substrings.LENGTH) -> list[tuple[int, int, int, str]]:
    seen, out = set(), []
    for value in values:
        data = (value or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, values, parts=5):
    rows = substrings.repeat_report(documents(spark, values).repartition(parts)).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(values)
    assert [found[k] for k in range(len(values))] == brute(values)


def repeated(seed: int, n: int = 60) -> list[str]:
    """Texts cut and pasted from one another, with small edits, runs and periodic parts."""
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choices("abé \n", k=k))
    pool = [fresh(rng.randint(90, 400)) for _ in range(8)] + ["ab" * 150, "x" * 260, fresh(7) * 60]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            part = rng.choice(pool + out[-5:] + [fresh(rng.randint(1, 200))])
            a = rng.randint(0, len(part))
            text += part[a : a + rng.choice([60, 99, 100, 101, 150, 1000])]
        if text and rng.random() < 0.3:
            at = rng.randint(0, len(text) - 1)
            text = text[:at] + "#" + text[at + 1 :]
        out.append(text)
    return out


def test_against_brute_force(spark):
    check(spark, texts())
    for seed in (1, 2):
        check(spark, repeated(seed))


def test_hot_and_large_groups(spark, monkeypatch):
    values = repeated(4, 40)
    rows = documents(spark, values).selectExpr("doc_id AS o", "0L AS k", "text")
    monkeypatch.setattr(substrings, "HOT_SHARE", 1)
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", 2)
    assert len(substrings.hot_anchors(rows)) > 5  # all of several contexts
    check(spark, values)
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 300)
    check(spark, values)
    monkeypatch.setattr(substrings, "STARTS", 10)
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", 1 << 20)
    check(spark, values)


def test_smaller_neighbours():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(0, 12)
        position, joined = rng.sample(range(99), n), [k > 0 and rng.random() < 0.7 for k in range(n)]
        before, after = substrings.smaller_neighbours(position, joined)
        for i in range(n):
            left = i
            while joined[left]:
                left -= 1
            right = i
            while right + 1 < n and joined[right + 1]:
                right += 1
            assert before[i] == max([j for j in range(left, i) if position[j] < position[i]], default=-1)
            assert after[i] == min([j for j in range(i + 1, right + 1) if position[j] < position[i]], default=-1)


def test_bytes_of_zero_and_null_differ(spark):
    check(spark, ["\0" * 150, "\0" * 99 + "a", "a" + "\0" * 120, "b" * 90 + "\0" * 12, "b" * 90 + "\0" * 10, "\0" * 300])


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 512)
    data = "".join(random.Random(4).choices("abcdef ", k=1500))
    value = np.frombuffer((data + "!" + data[200:900]).encode(), np.uint8)
    found = set()
    for at in range(0, len(value) - 99, 512 - 99):
        block = value[at : at + 512]
        a = substrings.anchors(block, np.full(len(block), len(block)))
        found |= {at + s + k for s, m in zip(a[2], a[3]) for k in range(m + 1)}
    assert found == set(range(len(value) - 99))


def test_edges(spark):
    assert substrings.repeat_report(empty(spark)).count() == 0
    docs = documents(spark, repeated(3, 12))
    once = sorted(map(tuple, substrings.repeat_report(docs).collect()))
    twice = sorted(map(tuple, substrings.repeat_report(docs.union(docs)).collect()))
    assert twice == sorted(once + once)  # rows equal in id and text are one text
    assert substrings.repeat_report(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 12


def by_position(spark, rows):
    """What loops remove from (id, text) rows, in the order of ids (null first) and of the hash of the text, per row."""
    schema = "doc_id long, text string"
    keyed = spark.createDataFrame(rows, schema).distinct().withColumn("k", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = sorted(map(tuple, keyed.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = dict(zip([(r[0], r[1]) for r in keyed], brute([r[1] for r in keyed])))
    found = substrings.repeat_report(spark.createDataFrame(rows, schema).repartition(7)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr)
    assert got == sorted(((k, *want[k, t]) for k, t in rows), key=repr)


def test_null_and_repeated_ids(spark):
    values = repeated(9, 80)
    by_position(spark, [(None if k % 3 == 0 else k % 7, v) for k, v in enumerate(values)])
    by_position(spark, [(None, v) for v in values + values[:20]])
    rng = random.Random(10)
    block = "".join(rng.choices("abcdefgh", k=150))
    made = lambda: "".join(rng.choices("ijklmnop", k=200)) + block + "".join(rng.choices("ijklmnop", k=200))
    by_position(spark, [(None, made()) for _ in range(3000)])
