"""Names that look alike are found by what they have in common, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillcheck.functions import text, vendors
from quillcheck.operators import duplicates, lookalikes

WORDS = "summit electrical supply elec manufacturing mfg mfr north n saint st street bank of america and trust the ses boa harbor freight hf acme customer services svc".split()


def _names():
    rng = random.Random(11)
    names = {"summit dba harbor freight", "harbor freight", "hrabor freight", "acme dba summit supply", "sumit supply", "the of", "to", "x", "harbor", "acme inc", "acme", "acme mfg", "acme manufacturing", "summit elec supply", "summit electrical supply"}
    names |= {" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 2, 3, 3, 4, 6]))) for _ in range(60)}
    for base in ("abcde", "abcdef", "customer 0000012", "customer 000000345", "a name of thirty one character", "a name of thirty two character x"):
        for _ in range(14):
            name = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(1, len(name))
                if rng.random() < 0.3:
                    name[at : at + 2] = name[at : at + 2][::-1]
                else:
                    name[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "7"])
            names.add("".join(name).strip())
    names = sorted(names)
    rng.shuffle(names)
    return names


def test_first_look_alikes_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "BLOCK", 50)  # a key in many blocks
    names = _names()
    table = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    asks = table.select(F.lit("a").alias("key"), F.lit(None).cast("double").alias("total"), F.col("k").cast("long").alias("_ask"), F.lit(True).alias("_open"), F.struct(F.lit(0).alias("id")).alias("_below"), F.lit(len(names)).alias("_last"), F.lit(len(names)).alias("_askers"), "name")
    named = table.select(F.lit("a").alias("key"), F.lit(None).cast("double").alias("_total"), F.struct(F.col("k").alias("id")).alias("_first"), (F.col("k") + 1).alias("_place"), F.lit(len(names)).alias("_askers"), "name")
    pairs = lookalikes.may_look_alike(vendors.name_sides(asks, "name", "x"), vendors.name_sides(named, "name", "y"), ["key"], 0, 0.01, 8, pair_cost=1 << 30).cache()
    judged = vendors.sides_alike(pairs, "x", "y").groupBy("_ask").agg(F.min(F.when(F.col("alike"), F.col("_first.id"))).alias("id"))
    got = {r._ask: r.id for r in judged.collect() if r.id is not None}
    reasons = vendors.near_reasons(table.select(F.col("name").alias("a")).crossJoin(table.select(F.col("name").alias("b"))), "a", "b").where("reason is not null").collect()
    at, want = {n: k for k, n in enumerate(names)}, {}
    for r in reasons:
        want[at[r.a]] = min(want.get(at[r.a], len(names)), at[r.b])
    assert got == want and {r.reason for r in reasons} == {"typo", "abbreviation", "initials", "words left out", "trading name"}
    assert pairs.count() < len(names) ** 2 / 8


def test_names_of_a_number_are_not_paired(spark, monkeypatch):
    counts, real = [], duplicates.sides_alike
    monkeypatch.setattr(duplicates, "sides_alike", lambda pairs, x, y: (counts.append(pairs.count()), real(pairs, x, y))[1])
    schema = "id int, number string, vendor string, tax string, vendor_id string, po string, total double"
    rows = lambda first, last, sign: spark.createDataFrame([(k, "N1", f"vendor {k * 7919 % 100_000:05}{sign * 4}", None, None, None, None) for k in range(first, last)], schema)
    got = {r.id: r.tier for r in duplicates.duplicate_claims(rows(0, 200, "u"), rows(200, 600, "v")).collect()}
    assert got == dict.fromkeys(range(200)) and sum(counts) < 200


def _table(names, per_key):
    return pa.table({
        "key": [k // per_key for k in range(len(names))], "_named": pa.array([int(k % per_key >= per_key // 2) for k in range(len(names))], pa.int32()), "text": names, "whole": names,
        "kind": pa.array([0] * len(names), pa.int32()), "_place": list(range(len(names))), "total": pa.array([None] * len(names), pa.float64()),
    })


def test_parts_of_any_size_find_the_same(monkeypatch):
    rng = random.Random(4)
    names = ["".join(rng.choices("abc", k=rng.choice([5, 6, 7, 17]))) for _ in range(1200)]
    per_key = 60

    def found(table):
        pairs = set()
        for part, group in lookalikes._groups(iter(table.to_batches(max_chunksize=37)), ["key"]):
            for i, j in lookalikes._pairs(part, group, 0.01, 1 << 30):
                pairs |= set(zip(part["_place"].to_numpy()[i].tolist(), part["_place"].to_numpy()[j].tolist()))
        return pairs

    allowed = lambda a, b: int(np.searchsorted([6, 16, 32], max(len(a), len(b)), "right"))
    want = set()
    for k in range(0, len(names), per_key):
        for i in range(k, k + per_key // 2):
            near = [j for j in range(k + per_key // 2, k + per_key) if names[j] != names[i] and text.edit_distance(names[i], names[j]) <= allowed(names[i], names[j])]
            want |= {(i, j) for j in near[:1]}
    table = _table(names, per_key)
    assert found(table) == want and len(want) > 50
    monkeypatch.setattr(lookalikes, "CHUNK", 50)
    monkeypatch.setattr(lookalikes, "HELD", 300)
    monkeypatch.setattr(lookalikes, "FIRST", 3)
    assert found(table) == want
