"""Mixed-width intervals and chains against plain loops."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quillcheck.operators import ledger, usage


def test_mixed_intervals_equal_loops(spark):
    rng = random.Random(2)
    replies = [(rng.choice("ab"), rng.randint(-400, 4000), rng.choice([None, 1, 2, 5])) for _ in range(400)] + [("a", None, 3), (None, 5, 3)]
    bills = []
    for _ in range(60):
        start = rng.randint(-50, 300) * 10
        bills.append((rng.choice("abc"), start, start + rng.choice([10, 60, 70, 640, 3000]), rng.randint(0, 60)))
    bills += [("a", 5, 25, 1), ("a", 20, 20, 1), ("b", 30, 10, 1), ("c", None, 20, 1)]
    frames = spark.createDataFrame(replies, "k string, at long, tokens long"), spark.createDataFrame(bills, "k string, start long, end long, billed long")
    got = sorted((tuple(r[:7]) for r in usage.by_mixed_buckets(*frames, ["k"], unit=10).collect()), key=repr)
    want, held = [], set()
    for k, a, b, billed in bills:
        if a is None or a % 10 or b % 10 or a >= b:
            want.append((k, a, b, 0, None, billed, "UNALIGNED"))
            continue
        inside = [i for i, (x, at, _) in enumerate(replies) if x == k and at is not None and a <= at < b]
        held |= set(inside)
        known = [replies[i][2] for i in inside if replies[i][2] is not None]
        total = sum(known) if known else None
        match = "NO_REPLIES" if not inside else "SHORT" if total is not None and billed < total else "EXACT" if total == billed and len(known) == len(inside) else "CONTAINED"
        want.append((k, a, b, len(inside), total, billed, match))
    lost = {}
    for i, (k, at, tokens) in enumerate(replies):
        if at is not None and i not in held:
            lost.setdefault((k, at // 10 * 10), []).append(tokens)
    want += [(k, a, a + 10, len(v), sum(x for x in v if x is not None) if any(x is not None for x in v) else None, None, "NOT_BILLED") for (k, a), v in lost.items()]
    assert got == sorted(want, key=repr)
    assert usage.by_mixed_buckets(frames[0].limit(0), frames[1], ["k"], unit=10).where("match = 'NO_REPLIES'").count() == 60
    assert usage.by_mixed_buckets(frames[0], frames[1].limit(0), ["k"], unit=10).where("match <> 'NOT_BILLED'").count() == 0


def _chain(values, name):
    out, head = [], "0" * 64
    for seq, v in enumerate(values):
        payload = hashlib.sha256(v.encode()).hexdigest()
        entry = hashlib.sha256(f"{seq}:{head}:{payload}".encode()).hexdigest()
        out.append((name, seq, v, payload, head, entry))
        head = entry
    return out


SCHEMA = "chain string, seq int, value string, payload_hash string, prev_hash string, entry_hash string"


def test_checkpoints(spark):
    a, b, c = _chain("abcdefgh", "a"), _chain("abcdefgh", "b"), _chain("abcXefgh", "c")
    b[6] = (*b[6][:2], "changed", *b[6][3:])
    heads = {n + 1: e[-1] for n, e in enumerate(_chain("abcdefgh", ""))}
    points = [(n, k, heads.get(k)) for n in "abcd" for k in (3, 5, 7, 8)] + [("a", 9, "x"), ("a", 0, None), ("a", None, None), ("a", 4, "forged"), ("a", 2, None)]
    found = ledger.against_checkpoints(spark.createDataFrame(a + b + c, SCHEMA), spark.createDataFrame(points, "chain string, length int, head string"), "chain", F.col("value"))
    got = {(r.chain, r.length): (r.status, r.since, r.upto) for r in found.collect()}
    held = ("held", None, None)
    assert got == {
        ("a", 3): held, ("a", 5): held, ("a", 7): held, ("a", 8): held, ("a", 9): ("truncated", None, None), ("a", 0): ("refused", None, None), ("a", None): ("refused", None, None),
        ("a", 4): ("rewritten", 3, 3), ("a", 2): ("rewritten", 0, 1), ("b", 3): held, ("b", 5): held, ("b", 7): ("broken", 5, 6), ("b", 8): ("broken", 5, 7),
        ("c", 3): held, ("c", 5): ("rewritten", 3, 4), ("c", 7): ("rewritten", 3, 6), ("c", 8): ("rewritten", 3, 7), **{("d", k): ("truncated", None, None) for k in (3, 5, 7, 8)},
    }


def test_a_number_that_stands_twice_breaks_a_chain(spark):
    rows = _chain("abc", "a") + _chain("abc", "b") + [_chain("abc", "b")[1]] + _chain("ab", None)
    got = {r.chain: (r.n, r.first_break, r.reason) for r in ledger.verify_chains(spark.createDataFrame(rows, SCHEMA), "chain", F.col("value")).collect()}
    assert got == {"a": (3, None, None), "b": (4, 1, "seq"), None: (2, None, None)}


def test_no_task_reads_a_whole_chain(spark):
    frame = spark.createDataFrame(_chain("abc", "a"), SCHEMA)
    plan = ledger.verify_chains(frame, "chain")._jdf.queryExecution().toString()
    assert "Window" not in plan
