from __future__ import annotations

from pyspark.sql import functions as F

from quillcheck.operators import ledger
from quillcheck.streaming import chains


def test_incremental_check_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(k % 3, k, f"p{k}") for k in range(30)], "chain int, id int, payload string")
    entries = ledger.build_chains(events, "chain", ["id"], F.col("payload"))
    entries = entries.withColumn("prev_hash", F.when((F.col("chain") == 1) & (F.col("seq") == 6), "x").otherwise(F.col("prev_hash"))).cache()
    for part in range(5):
        entries.where((F.col("seq") >= 2 * part) & (F.col("seq") < 2 * part + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = chains.read_stream(spark, str(tmp_path / "log"), entries._jdf.schema().toDDL())
    chains.run_available(chains.verify_incrementally(stream, "chain"), "checked", "update", str(tmp_path / "cp"))
    got = {tuple(r) for r in chains.latest_state(spark, "checked", "chain").select("chain", "n", "head", "first_break", "reason").collect()}
    assert got == {tuple(r) for r in ledger.verify_chains(entries, "chain").select("chain", "n", "head", "first_break", "reason").collect()}


def test_windows_close_by_later_events(spark, tmp_path):
    rows = spark.range(100).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 2).alias("k"), F.lit(2).alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = chains.read_stream(spark, str(tmp_path / "in"), "ts timestamp, k long, v int")
    chains.run_available(chains.windowed_usage(stream, "ts", "10 minutes", "0 seconds", ["k"], "v"), "windows", "append", str(tmp_path / "cp"))
    got = spark.table("windows").collect()
    assert len(got) == 18 and all(r.n == 5 and r.total == 10 for r in got)
