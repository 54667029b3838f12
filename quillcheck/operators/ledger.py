"""An append-only log: hash chains, calendar periods, reproducible samples and what was in force when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

GENESIS = "0" * 64


def entry_hash(seq: Column, prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws(":", seq.cast("string"), prev, payload), 256)


def build_chains(events: DataFrame, chain: str, order: list[str], payload: Column) -> DataFrame:
    """Events with seq (dense from 0), payload_hash, prev_hash and entry_hash per chain.

    Building is a fold, so each chain is built in order by one task: rows are dealt by chain and sorted, and a task streams
    them with the last chain, hash and seq alone in hand, so that a chain may be of any length.
    """
    rows = events.withColumn("payload_hash", F.sha2(payload, 256)).repartition(chain).sortWithinPartitions(chain, *order)
    schema = T.StructType(
        [events.schema[chain], *[f for f in events.schema if f.name != chain], T.StructField("seq", T.IntegerType()), T.StructField("payload_hash", T.StringType()),
         T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())]
    )

    def link(batches):
        import hashlib

        import pyarrow as pa

        here, seq, head = None, -1, GENESIS
        for batch in batches:
            seqs, before, after = [], [], []
            for key, payload_hash in zip(batch.column(chain).to_pylist(), batch.column("payload_hash").to_pylist()):
                if seq < 0 or not (key == here or (key != key and here != here)):
                    here, seq, head = key, -1, GENESIS
                seq += 1
                before.append(head)
                head = hashlib.sha256(":".join(x for x in (str(seq), head, payload_hash) if x is not None).encode()).hexdigest()
                seqs.append(seq)
                after.append(head)
            made = {"seq": pa.array(seqs, pa.int32()), "prev_hash": pa.array(before, pa.string()), "entry_hash": pa.array(after, pa.string())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in schema.names], schema.names)

    return rows.mapInArrow(link, schema)


def _reasons(entries: DataFrame, chain: str, payload: Column | None, after: Column | None) -> DataFrame:
    """Entries (chain, seq, entry_hash) with ``_why``: what is wrong with one, null if nothing.

    An entry meets the one before by an equality of chain and number, so entries are dealt by both and a chain of any
    length is shared by all tasks.
    """
    start = F.lit(-1) if after is None else after
    content = F.lit(False) if payload is None else F.col("payload_hash") != F.sha2(payload, 256)
    wrong = F.col("entry_hash") != entry_hash(F.col("seq"), F.col("prev_hash"), F.col("payload_hash"))
    own = F.when(wrong, "entry_hash").when(content, "payload")
    rows = entries.select(chain, "seq", "entry_hash", "prev_hash", own.alias("_own"), (F.col("seq") > start).alias("_read"))
    before = rows.groupBy(F.col(chain).alias("_c"), (F.col("seq") + 1).alias("_s")).agg(F.count("*").alias("_n"), F.max("entry_hash").alias("_before"))
    again = rows.groupBy(F.col(chain).alias("_c2"), F.col("seq").alias("_s2")).agg((F.count("*") > 1).alias("_twice"))
    rows = rows.join(before, F.col(chain).eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")), "left")
    rows = rows.join(again, F.col(chain).eqNullSafe(F.col("_c2")) & (F.col("seq") == F.col("_s2")), "left")
    gap = ((F.col("seq") != 0) & F.col("_n").isNull()) | F.coalesce("_twice", F.lit(False))
    unlinked = F.col("prev_hash") != F.coalesce("_before", F.lit(GENESIS))
    why = F.when(gap, "seq").when(unlinked, "prev_hash").otherwise(F.col("_own"))
    return rows.select(chain, "seq", "entry_hash", F.when(F.col("_read"), why).alias("_why"))


def _verdicts(checked: DataFrame, chain: str) -> DataFrame:
    out = checked.groupBy(chain).agg(
        F.count("*").alias("n"), F.max_by("entry_hash", "seq").alias("head"), F.min(F.when(F.col("_why").isNotNull(), F.struct("seq", "_why"))).alias("_bad")
    )
    return out.select(chain, "n", "head", F.col("_bad.seq").alias("first_break"), F.col("_bad._why").alias("reason"))


def verify_chains(entries: DataFrame, chain: str, payload: Column | None = None, after: Column | None = None) -> DataFrame:
    """Per chain its length, head, and the first sequence number that breaks it with the reason, if any.

    Checks that numbers are dense from 0 and none stands twice, that each entry names the one before, that entry hashes
    recompute, and (with ``payload``) that payload hashes do. Every entry is checked from its neighbour alone, so chains need
    no fold and no task reads a whole one. ``after`` names the last number already certified; entries up to it are taken as
    read.
    """
    return _verdicts(_reasons(entries, chain, payload, after), chain)


def against_checkpoints(entries: DataFrame, checkpoints: DataFrame, chain: str, payload: Column | None = None) -> DataFrame:
    """Checkpoints (chain, length, head: the hash of the entry that was the last then) with ``status`` and, where the chain
    is another one, the numbers ``since`` to ``upto`` between which it changed.

    truncated: the chain is shorter than it was. broken: it does not verify up to there. rewritten: it verifies, but its
    entry has another hash, as after a change that recomputes all that follows. held: as it was. ``since`` is the length of
    the last checkpoint before that held. A checkpoint meets its entry by chain and number, and its chain's verdict; of the
    chain's checkpoints only these are put in order. A chain without entries is truncated; a length under 1 is refused.
    """
    checked = cut(_reasons(entries, chain, payload, None))
    verdict = _verdicts(checked, chain).select(F.col(chain).alias("_c"), "n", "first_break")
    at = checked.groupBy(F.col(chain).alias("_d"), (F.col("seq") + 1).alias("_length")).agg(F.max("entry_hash").alias("_head"))
    rows = checkpoints.select(chain, "length", "head").join(verdict, F.col(chain) == F.col("_c"), "left")
    rows = rows.join(at, (F.col(chain) == F.col("_d")) & (F.col("length") == F.col("_length")), "left")
    status = (
        F.when(F.coalesce(F.col("length") < 1, F.lit(True)), "refused").when(F.col("length") > F.coalesce("n", F.lit(0)), "truncated")
        .when(F.col("first_break") < F.col("length"), "broken").when(F.col("_head").eqNullSafe(F.col("head")), "held").otherwise("rewritten")
    )
    rows = rows.select(chain, "length", "head", status.alias("status"))
    earlier = W.partitionBy(chain).orderBy("length").rangeBetween(W.unboundedPreceding, -1)
    since = F.coalesce(F.max(F.when(F.col("status") == "held", F.col("length"))).over(earlier), F.lit(0))
    changed = F.col("status").isin("broken", "rewritten")
    return rows.select(chain, "length", "status", F.when(changed, since).alias("since"), F.when(changed, F.col("length") - 1).alias("upto"))


def chain_periods(events: DataFrame, chain: list[str], seq: str, ts: str, unit: str) -> DataFrame:
    """Events with the calendar period they belong to: that of the largest time so far, so an event whose clock steps
    back stays in the open period and none is ever dropped."""
    clock = F.max(ts).over(W.partitionBy(*chain).orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("period", F.date_trunc(unit, clock))


def close_periods(events: DataFrame, chain: list[str], seq: str) -> DataFrame:
    """Per chain and period its events, first and last number, and the number that closed it (null while open)."""
    spans = events.groupBy(*chain, "period").agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
    return spans.withColumn("closed_by", F.lead("first_seq").over(W.partitionBy(*chain).orderBy("period")))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc())))
    return ranked.where("_n = 1").drop("_n")


def draw_size(rate: float, n: Column) -> Column:
    return F.least(n, F.ceil(rate * n - 1e-9))


def draw(rows: DataFrame, strata: list[str], id_col: str, seed: str, rate: float) -> DataFrame:
    """A reproducible share of each stratum: the ids with the smallest hashes of seed, stratum and id. A larger rate
    draws all of a smaller one's.

    A stratum may hold most rows, so its rank is never taken whole: each of 256 slices of a stratum, by the hash's first
    bits, is ranked alone, and slices below come in by their counts.
    """
    key = F.sha2(F.concat_ws(":", F.lit(seed), *strata, F.col(id_col).cast("string")), 256)
    hashed = rows.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, 2))
    counts = hashed.groupBy(*strata, "_slice").agg(F.count("*").alias("_c"))
    by = W.partitionBy(*strata)
    counts = counts.withColumn("_before", F.sum("_c").over(by.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))).withColumn("_n", F.sum("_c").over(by))
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(*strata, "_slice").orderBy("_key", id_col)))
    both = ranked.join(counts.drop("_c"), [*strata, "_slice"])
    place = F.col("_r") + F.coalesce("_before", F.lit(0))
    return both.withColumn("draw_rank", place).where(place <= draw_size(rate, F.col("_n"))).select(*rows.columns, "draw_rank")


def in_force(events: DataFrame, chain: list[str], seq: str, state: Column) -> DataFrame:
    """Events with ``in_force``: the last non-null state strictly before each."""
    w = W.partitionBy(*chain).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("in_force", F.last(state, ignorenulls=True).over(w))


def fingerprint(rows: DataFrame, key: str, row: Column, bits: int = 12) -> DataFrame:
    """One hash of a whole table in the order of its integer key, the same however the rows are dealt: ``n`` and ``hash``.

    Rows are hashed, slices of 2**bits keys hash their rows' hashes in order, and slices of slices theirs, three times; so
    no group holds more than 2**bits hashes while keys are unique (rows that share one stand in the order of their hashes),
    and the last one a row for every 2**(3 * bits) keys. Null keys come first. An empty table gives one row with the hash of
    nothing.
    """
    level = rows.select(F.col(key).cast("long").alias("k"), F.sha2(F.coalesce(row, F.lit("")), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for last in (False, False, False, True):
        ordered = F.array_sort(F.collect_list(F.struct(F.col("k").isNotNull().alias("set"), "k", "h")))
        hashes = F.concat_ws("", F.transform(ordered, lambda r: r["h"]))
        groups = level.groupBy() if last else level.groupBy(F.shiftright("k", bits).alias("g"))
        level = groups.agg(F.sha2(hashes, 256).alias("h"), F.sum("n").alias("n"))
        level = level if last else level.withColumnRenamed("g", "k")
    return level.select(F.coalesce("n", F.lit(0)).alias("n"), F.col("h").alias("hash"))


def bottom_k(refs: DataFrame, ref: str, seed: str, k: int) -> DataFrame:
    """``k`` references drawn by a seed: those whose hash with it is smallest, in that order (``rank`` from 1). Equal
    references draw once, null ones never; each task keeps k of its own, so nothing is ranked whole."""
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), F.col(ref).cast("string")), 256)
    drawn = refs.select(ref).where(F.col(ref).isNotNull()).distinct().withColumn("h", hashed).orderBy("h").limit(k)
    ranked = drawn.groupBy().agg(F.array_sort(F.collect_list(F.struct("h", ref))).alias("all")).select(F.posexplode("all").alias("p", "r"))
    return ranked.select((F.col("p") + 1).alias("rank"), F.col(f"r.{ref}").alias(ref))


def schedules(keys: Column, count: int, seed: Column) -> Column:
    """Orders in which to show some options: as given, reversed, then shuffles by hash with the seed and a number; each order
    once, so few options give fewer than ``count``."""

    def shuffle(n: int) -> Column:
        hashed = F.transform(keys, lambda k: F.struct(F.md5(F.concat_ws(":", seed, F.lit(str(n)), k.cast("string"))).alias("h"), k.alias("k")))
        return F.transform(F.array_sort(hashed), lambda r: r["k"])

    return F.array_distinct(F.array(*[keys, F.reverse(keys), *[shuffle(n) for n in range(2, count)]][:count]))
