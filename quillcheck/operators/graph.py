"""Statuses over a graph of tasks: what is done, blocked or open, from the leaves up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def roll_up(nodes: DataFrame, parents: DataFrame, rounds: int = 64) -> DataFrame:
    """Nodes with ``done``, ``total`` (leaves under each, itself if a leaf) and state: DONE, PARTLY or OPEN.

    ``nodes`` has id and own (whether a leaf is done), ``parents`` child and parent, without cycles. Each round moves
    every leaf's count one level up; a node with several parents counts in each path once. Stored at each round.
    """
    leaves = nodes.join(parents, nodes["id"] == parents["parent"], "left_anti")
    carried = cut(leaves.select(F.col("id").alias("at"), F.col("id").alias("leaf"), F.col("own").cast("int").alias("own")))
    seen = carried
    for _ in range(rounds):
        up = carried.join(parents, carried["at"] == parents["child"]).select(F.col("parent").alias("at"), "leaf", "own").distinct()
        carried = cut(up.join(seen, ["at", "leaf"], "left_anti"))
        if carried.isEmpty():
            break
        seen = seen.unionByName(carried)
    counts = seen.groupBy("at").agg(F.sum("own").alias("done"), F.count("*").alias("total"))
    state = F.when(F.col("done") == F.col("total"), "DONE").when(F.col("done") > 0, "PARTLY").otherwise("OPEN")
    return counts.select(F.col("at").alias("id"), "done", "total", state.alias("state"))
