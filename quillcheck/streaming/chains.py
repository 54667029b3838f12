"""The log as a stream: chains checked as entries arrive, and calendar periods that close by later events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import GENESIS, entry_hash

STATE = "next_seq long, head string, first_break long, reason string"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """An append-only folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def verify_incrementally(entries: DataFrame, chain: str) -> DataFrame:
    """Per chain and batch the certified length, head and first break so far.

    The hash of each entry is recomputed by Spark before it reaches the state; the state holds two numbers and two texts
    a chain, so only new entries are ever looked at. Entries of a chain must arrive in files in order of seq.
    """
    wrong = F.col("entry_hash") != entry_hash(F.col("seq"), F.col("prev_hash"), F.col("payload_hash"))
    rows = entries.select(chain, F.col("seq").cast("long").alias("seq"), "prev_hash", "entry_hash", wrong.alias("wrong"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, head, broken, reason = state.get if state.exists else (0, GENESIS, None, None)
        found = pd.concat(list(batches)).sort_values("seq")
        for seq, prev, own, bad in zip(found["seq"], found["prev_hash"], found["entry_hash"], found["wrong"]):
            if broken is None:
                why = "seq" if seq != following else "prev_hash" if prev != head else "entry_hash" if bad else None
                if why:
                    broken, reason = int(seq), why
            following, head = int(seq) + 1, own
        state.update((following, head, broken, reason))
        yield pd.DataFrame({chain: [key[0]], "n": [following], "head": [head], "first_break": pd.array([broken], "Int64"), "reason": [reason]})

    kind = rows.schema[chain].dataType.simpleString()
    return rows.groupBy(chain).applyInPandasWithState(
        step, f"{chain} {kind}, n long, head string, first_break long, reason string", STATE, "update", "NoTimeout"
    )


def latest_state(spark: SparkSession, table: str, chain: str) -> DataFrame:
    """The last row that a stream in update mode wrote for each chain to a memory table."""
    return spark.table(table).groupBy(chain).agg(F.max_by(F.struct("n", "head", "first_break", "reason"), "n").alias("s")).select(chain, "s.*")


def windowed_usage(events: DataFrame, ts: str, window: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by tumbling window and keys; a window is given out once no event that late can still come."""
    stamped = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    out = stamped.groupBy(F.window("_at", window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Runs a stream over what is there to a memory table, and returns when done."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
