"""Trees given by each node's parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def tree_places(nodes: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """Each node of the trees of ``keys`` with ``root``, the topmost node above it, and ``depth``, the steps up to it (0 for a root).

    Pointers are doubled: each round a node takes over the pointer of the node that its own points at, so a tree of depth d
    needs log2(d) rounds of one join by equality, and no tree is held by one task. A node whose parent is null or not in the
    table is a root. Of a node that comes twice the row with the smallest parent counts. Nodes of a ring, and those below
    one, have no root: both are null. Rows without a node are left out; null keys are keys like any other.
    """
    rows = nodes.where(F.col(node).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(node).alias("_n"), F.col(parent).alias("_p"))
    rows = rows.groupBy("_k", "_n").agg(F.min("_p").alias("_p"))
    known = rows.select("_k", F.col("_n").alias("_p"), F.lit(True).alias("_in"))
    at = rows.join(known, ["_k", "_p"], "left").select("_k", "_n", F.when(F.col("_in"), F.col("_p")).alias("_up"))
    # _up is null once a root is reached; _top is where the steps so far lead
    at = cut(at.select("_k", "_n", "_up", F.coalesce("_up", "_n").alias("_top"), F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long").alias("_d")))
    open_before, still = -1, at.where("_up is not null").count()
    while still and still != open_before:  # while any node is below a root, each round closes some
        above = at.select("_k", F.col("_n").alias("_up"), F.col("_up").alias("_next"), F.col("_top").alias("_t"), F.col("_d").alias("_more"))
        at = at.join(above, ["_k", "_up"], "left")
        open_ = F.col("_up").isNotNull()
        at = cut(at.select("_k", "_n", F.col("_next").alias("_up"), F.when(open_, F.col("_t")).otherwise(F.col("_top")).alias("_top"), F.when(open_, F.col("_d") + F.col("_more")).otherwise(F.col("_d")).alias("_d")))
        open_before, still = still, at.where("_up is not null").count()
    closed = F.col("_up").isNull()
    return at.select("_k.*", F.col("_n").alias(node), F.when(closed, F.col("_top")).alias("root"), F.when(closed, F.col("_d")).alias("depth"))
