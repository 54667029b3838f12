from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillcheck.llm import quality

from .corpus import documents, empty


def _corpus(spark, n=900):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    texts, marks = [], []
    for _ in range(n):
        good = rng.random() < 0.7
        own = rng.choices(words, k=rng.randint(20, 80))
        texts.append(" ".join(own) + "." if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in own))
        marks.append(int(good))
    labels = [(k, m, 0) for k, m in enumerate(marks) if k % 3] + [(1, marks[1], 0), (5, None, 0), (None, 1, 0)]
    texts += [None, "", "word " * 50_000]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), marks


def test_held_out_accuracy(spark):
    docs, labels, marks = _corpus(spark)
    rows = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(rows) == len(marks) + 3
    held = [k for k in range(len(marks)) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in range(len(marks)) if rows[k].held_out] == held
    assert np.mean([rows[k].predicted == marks[k] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels, _ = _corpus(spark, 300)
    changed = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = sorted(map(str, quality.score_quality(docs, labels).collect()))
    assert one == sorted(map(str, quality.score_quality(docs.repartition(3), changed).collect()))


def test_edges(spark):
    docs, labels, _ = _corpus(spark, 30)
    assert quality.score_quality(empty(spark), labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}


def test_contexts_by_plain_loops():
    texts = ["a b c d", "", "b B1 a", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    total = np.zeros((quality.VOCABULARY, quality.SIZE + 1), np.int64)
    for out in quality._sum_contexts(iter([batch])):
        g = out.column("g")[0].as_py()
        total[g * quality.GROUP : (g + 1) * quality.GROUP] = np.frombuffer(out.column("v")[0].as_py(), np.int64).reshape(quality.GROUP, -1)
    want = np.zeros_like(total)
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        rows, _ = quality.tokens(data, np.array([0, len(data)]))
        for i, w in enumerate(rows):
            want[w, -1] += 1
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if j != i:
                    want[w, :-1] += quality.index_vectors()[rows[j]]
    assert (total == want).all()


def test_pooling_by_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK", 4)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(quality.VOCABULARY, quality.SIZE)).astype(np.float32)
    for n in (0, 1, 2, 3, 5, 9, 40):
        own = rng.integers(0, 12, n)
        found = quality.pooled(own, vectors).reshape(6, -1)
        rows = [vectors[i].astype(float) for i in own]
        want = np.zeros((6, quality.SIZE))
        if n:
            want[0] = sum(rows) / n
            want[1] = sum(vectors[i].astype(float) for i in set(own.tolist())) / len(set(own.tolist()))
            want[2] = np.sqrt(np.maximum(sum(r * r for r in rows) / n - want[0] ** 2, 0))
            want[3] = sum(rows) / n**0.5
            for step in (1, 2):
                pairs = [rows[i] * rows[i + step] for i in range(n - step)]
                want[3 + step] = sum(pairs, np.zeros(quality.SIZE)) / max(1, n - step)
        assert np.allclose(found, want, atol=1e-3)


def test_network_by_plain_loops_and_temperature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0).astype(float)
    net = quality.Network(hidden=4).fit(x, y)
    for row, score in zip(x[:20], net.predict(x[:20])):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [np.tanh(sum(v * net.weights[0][i][j] for i, v in enumerate(z)) + net.weights[1][j]) for j in range(4)]
        logit = sum(h * w for h, w in zip(hidden, net.weights[2])) + net.weights[3][0]
        assert abs(score - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    held = np.arange(600) % 5 == 4
    loss = lambda t: -np.mean([np.log(p if k else 1 - p) for p, k in zip(quality._logistic(net._logit((x[held] - net.mean) / net.scale) / t), y[held])])
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 61))


def test_repeated_ids_bring_no_more_rows(spark):
    docs, labels, _ = _corpus(spark, 60)
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" more")))).union(docs)
    vectors = docs.sparkSession.sparkContext.broadcast(quality.word_vectors(docs))
    x, y = quality.training_rows(twice, labels, vectors, "doc_id", "text", "quality", 16)
    assert len(x) == len(y) <= 16
    assert quality.score_quality(twice, labels).count() == 3 * docs.count()
