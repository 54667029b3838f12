"""SimHash fingerprints and their links by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import chunks
from .components import components

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: A key is hot if more than one in HOT rows has it; so there are at most HOT hot keys, whatever the number of rows.
HOT = 2000
#: Fingerprints of a bucket that are compared with one another; a larger bucket is split by more of its bits.
BUCKET = 200


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of UTF-8 bytes: a bit is 1 if set in over half of the XXH64 of the word shingles, repeats included."""
    from xxhash import xxh64_digest

    words = data.lower().split()  # bytes: lower-cases A-Z and splits at 0x20 and 0x09 to 0x0D only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 15):
        stop = min(n, start + (1 << 15))
        parts = [words[start + k : stop + k] for k in range(shingle)] if len(words) >= shingle else [[w] for w in words]
        hashes = b"".join([xxh64_digest(x, seed) for x in map(b" ".join, zip(*parts))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """Per row: id and fp, the fingerprint as a signed long. Null counts as empty; a text without words has 0.
    Texts are read whole, in blocks of shingles. Repeated rows get rows of their own; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [fingerprint((x or "").encode(), shingle, seed) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join what is linked inside each bucket, as a tree to the smallest place of each part.

    A pair is compared in full only if it passes the ring test from the bucket's first segment: over one, two and three
    segments in a row the differing bits are at most that share of ``most``. A linked pair passes from some segment.
    """
    for batch in batches:
        lists = batch.column("fps")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        sizes = np.diff(ends, prepend=0)
        fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        end = np.repeat(ends, sizes)
        turn = np.repeat(batch.column("start").to_numpy(zero_copy_only=False), sizes).astype(np.uint64) * np.uint64(WIDTH)
        left, right = [], []
        at = np.arange(len(fps))
        for step in range(1, int(sizes.max(initial=1))):
            at = at[at + step < end[at]]
            differ = fps[at] ^ fps[at + step]
            ring = (differ >> turn[at]) | (differ << ((np.uint64(BITS) - turn[at]) & np.uint64(BITS - 1)))
            passed = np.ones(len(at), bool)
            for k in range(1, SEGMENTS):
                mask = np.uint64((1 << (WIDTH * k)) - 1)
                passed &= np.bitwise_count(ring & mask) <= most * k // SEGMENTS
            near = at[passed]
            near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= most]
            left.append(near)
            right.append(near + step)
        root = np.arange(len(fps))
        if left and len(a := np.concatenate(left)):
            b = np.concatenate(right)
            while True:
                was = root.copy()
                np.minimum.at(root, b, root[a])
                np.minimum.at(root, a, root[b])
                root = root[root]
                if (root == was).all():
                    break
        child = np.flatnonzero(root != np.arange(len(fps)))
        signed = fps.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], ["a", "b"])


def _quarter(j: int) -> str:
    """Mask of the j-th quarter of the bits in which a bucket's fingerprints vary."""
    n = "size(_bits)"
    return (
        f"aggregate(slice(_bits, cast({j} * {n} div 4 as int) + 1, cast({j + 1} * {n} div 4 as int) - cast({j} * {n} div 4 as int)),"
        " 0L, (m, b) -> m | shiftleft(1L, b))"
    )


def links(fps: DataFrame, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` which differ in at most ``most`` bits.

    Two such fingerprints agree in one of four segments, so they meet in a bucket of that segment. A bucket of more
    than ``bucket`` fingerprints is split again: bits in which all of it agree tell nothing, the others are dealt into
    four parts, and linked fingerprints agree in one part. So no bucket is compared whole, whatever its size, and none
    is cut short. As the fingerprints are distinct, a bucket that large varies in at least 8 bits and every split fixes
    a quarter of them, so the splitting ends. The rows of hot buckets stay where they are: those buckets, at most HOT,
    are sent to the tasks. Only row counts and the test whether large buckets are left come to the driver.
    """
    if most >= SEGMENTS:
        raise ValueError("a difference of as many bits as segments could miss links")
    if bucket < 16:
        raise ValueError("a bucket of fewer than 16 may not vary in enough bits to be split")
    hot = lambda total: F.col("n") > F.greatest(F.lit(bucket), F.lit(total / HOT))
    starts = [F.struct(F.lit(s).alias("start"), F.expr(f"shiftrightunsigned(fp, {WIDTH * s}) & {(1 << WIDTH) - 1}L").alias("key")) for s in range(SEGMENTS)]
    rows = fps.select("fp", F.explode(F.array(*starts)).alias("_s")).select("fp", "_s.*")
    parts = []
    while True:
        sizes = rows.groupBy("start", "key").agg(
            F.count("*").alias("n"), F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")
        )
        total = rows.count()
        sizes = cut(sizes.where("n > 1"))
        small = sizes.where(F.col("n") <= bucket).select("start", "key")
        varied = "filter(sequence(0, 63), b -> shiftrightunsigned(some & ~every, b) & 1L = 1L)"
        large = sizes.where(F.col("n") > bucket).select("start", "key", "n", F.expr(varied).alias("_bits"))
        large = large.select("start", "key", "n", F.array(*[F.expr(_quarter(j)) for j in range(4)]).alias("_masks"))
        heavy = F.broadcast(large.where(hot(total)).drop("n"))  # at most HOT buckets, each with over 1 / HOT of the rows
        others = rows.join(heavy.select("start", "key"), ["start", "key"], "left_anti")
        groups = others.join(small, ["start", "key"]).groupBy("start", "key")
        groups = groups.agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("start", "fps")
        parts.append(cut(groups.mapInArrow(lambda x: _forest(x, most), "a long, b long").distinct()))
        if large.isEmpty():
            break
        rows = rows.join(heavy, ["start", "key"]).unionByName(others.join(large.where(~hot(total)).drop("n"), ["start", "key"]))
        rows = rows.select("fp", "start", "key", F.posexplode("_masks").alias("_j", "_m"))
        rows = cut(rows.select("fp", "start", F.xxhash64("key", "_j", F.col("fp").bitwiseAND(F.col("_m"))).alias("key")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, seed: int = 42
) -> DataFrame:
    """Per row: the id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over links.

    Texts are lower-cased in A-Z and cut to words at ASCII blanks; the fingerprint is of their word shingles, repeats
    included (fewer words: the whole sequence; none, empty or null: zero). Fingerprints that differ in at most ``most``
    bits are linked. Equal fingerprints are one node, so a group of copies costs one; fingerprints (not texts) are
    stored and shuffled. Rows that repeat an id get a row each; a null id never names a component unless all ids in it
    are null. Other columns are ignored. No rows give no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    found = components(links(nodes.select("fp"), most))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    nodes = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    firsts = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    nodes = cut(nodes.join(firsts, "root").select("fp", "n", "component_id"))
    heavy = F.broadcast(nodes.where(F.col("n") > total / HOT).select("fp", "component_id"))  # at most HOT fingerprints
    others = rows.join(heavy, "fp", "left_anti").join(nodes.where(F.col("n") <= total / HOT).drop("n"), "fp")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(heavy, "fp").unionByName(others).select(F.col("id").alias(id_col), shown, "component_id")


def first_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, seed: int = 42
) -> DataFrame:
    """One whole row of ``docs`` for each component of near duplicates: that with the smallest id.

    Of rows that share the id (a null id comes after all others) the one with the smallest hash of its text stays, and of
    rows equal in id and text the one with the smallest hash of all its columns; so rows with null or repeated ids are
    lost only to a near copy of their text. Rows without words are copies of one another. Columns pass through unchanged,
    however named. No rows give no rows. Texts are shuffled once, to meet the (id, hash) of the rows that stay; rows equal
    in both are reduced to one before that.
    """
    columns = docs.columns
    inner = [f"_c{k}" for k in range(len(columns))]  # so that no column can clash with a helper
    docs = docs.toDF(*inner)
    own = dict(zip(columns, inner))
    key = F.struct(F.col(own[id_col]).isNull().alias("none"), F.col(own[id_col]).alias("id"), F.xxhash64(own[text_col]).alias("hash"))
    rows = cut(fingerprints(docs.select(key.alias("_key"), F.col(own[text_col]).alias("_text")), "_key", "_text", shingle, seed))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(nodes.select("fp"), most))
    nodes = nodes.join(found, nodes["fp"] == found["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = nodes.agg(F.min("first").alias("_k")).select("_k.none", F.col("_k.hash").alias("hash"), F.col("_k.id").alias("id"))
    flat = lambda x, k: x.select(  # noqa: E731  join keys without null
        *k, F.col("none").alias("_none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_id"), F.col("hash").alias("_hash")
    )
    docs = flat(docs.select("*", key.alias("_key")).select(*inner, "_key.*"), inner)
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        every = F.struct(*inner)
        docs = docs.groupBy("_none", "_id", "_hash").agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("_row"))
        docs = docs.select("_row.*", "_none", "_id", "_hash")
    return docs.join(flat(kept, []), ["_none", "_id", "_hash"], "left_semi").select(*inner).toDF(*columns)
