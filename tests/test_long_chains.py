from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillcheck.operators import ledger


def test_a_chain_is_streamed_not_collected(spark):
    n = 30_000  # several Arrow batches, most of them one chain
    events = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "x").alias("chain"), F.when(F.col("id") != 7, F.col("id")).cast("string").alias("p"), "id")
    built = ledger.build_chains(events, "chain", ["id"], F.col("p"))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    want, heads = {}, {}
    for k in range(n):
        chain = "hot" if k % 3 else "x" if k % 2 == 0 else None
        seq, head = heads.get(chain, (0, ledger.GENESIS))
        parts = [str(seq), head] + ([] if k == 7 else [hashlib.sha256(str(k).encode()).hexdigest()])
        entry = hashlib.sha256(":".join(parts).encode()).hexdigest()
        want[k] = (chain, seq, head, entry)
        heads[chain] = (seq + 1, entry)
    assert {r.id: (r.chain, r.seq, r.prev_hash, r.entry_hash) for r in built.collect()} == want
