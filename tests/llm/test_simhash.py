from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from quillcheck.llm import simhash
from quillcheck.llm.components import components

from .corpus import documents, empty, texts


def brute_fingerprint(text: str) -> int:
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], most: int = 3) -> list[int]:
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    values = texts() + ["UPPER case Ünder", "upper CASE Ünder"]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, values)).collect()}
    fps = [brute_fingerprint(v or "") for v in values]
    assert [int(rows[k].fingerprint, 16) for k in range(len(values))] == fps
    assert [rows[k].component_id for k in range(len(values))] == brute_components(fps)


def test_links_of_dense_groups(spark):
    rng = random.Random(5)
    base, varied = rng.getrandbits(64), rng.sample(range(64), 14)
    fps = {base}
    while len(fps) < 700:  # far more than a bucket, all within a few bits
        fps.add(base ^ sum(1 << b for b in rng.sample(varied, rng.randint(1, 9))))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:100]:
        fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bucket in (16, 200):
        found = {r.node: r.root for r in components(simhash.links(table, bucket=bucket)).collect()}
        want = brute_components([x & (1 << 64) - 1 for x in fps])
        assert [found.get(x, x) for x in fps] == [fps[k] for k in want]


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = components(chain.union(spark.createDataFrame([(100, 101)], "a long, b long"))).collect()
    assert {r.node: r.root for r in found} == {**{k: 0 for k in range(1, 60)}, 101: 100}


def test_edges(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    docs = documents(spark)
    kept = [r.doc_id for r in simhash.first_of_each(docs.union(docs)).collect()]
    assert len(kept) == len(set(kept))
    assert simhash.first_of_each(docs).columns == docs.columns
    nameless = documents(spark, ["a b", "a b", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.near_duplicates(nameless).count() == 3


def test_one_row_of_each_group_stays(spark):
    one, two, three = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(None, one, 1), (None, two, 2), (None, None, 3), (7, two, 4), (7, three, 5), (8, three, 6), (9, three, 7), (9, three, 7), (9, one, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "_id")
    want = {(7, two, 4), (7, three, 5), (9, one, 8), (None, None, 3)}
    for parts in (1, 4):
        got = [tuple(r) for r in simhash.first_of_each(docs.repartition(parts)).collect()]
        assert len(got) == 4 and set(got) == want
    for text in (one, None):
        same = spark.createDataFrame([(k, text, v) for k in (1, None) for v in (3, 2, 2)], docs.schema)
        assert [tuple(r) for r in simhash.first_of_each(same).collect()][0][:2] == (1, text)
        assert simhash.first_of_each(same).count() == 1
        assert simhash.first_of_each(same.where("doc_id is null")).count() == 1
    assert simhash.first_of_each(docs.where("false")).count() == 0


def test_hot_buckets_and_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)  # most of what repeats is hot
    values = texts() + [None] * 40 + ["a b c d"] * 30
    fps = [brute_fingerprint(v or "") for v in values]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, values)).collect()}
    assert [rows[k] for k in range(len(values))] == brute_components(fps)
    rng = random.Random(8)
    near = sorted({sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(600)})
    found = components(simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"), bucket=16)).collect()
    assert [{r.node: r.root for r in found}.get(x, x) for x in near] == [near[k] for k in brute_components(near)]
