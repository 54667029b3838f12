"""Document fingerprints: one-permutation MinHash, densified, with packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, flat
from .wordhash import mixed, shingle_hashes, word_hashes

BINS, LOW = 512, 4
SHINGLE = 5
#: Ranges of ids at most: their bounds come from one sketch, whose size grows with their number.
RANGES = 8192
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=4)
def _donors(bins: int, tries: int = 1024) -> np.ndarray:
    """For each try and bin, the bin that an empty one asks: a random function of both, the same for all texts."""
    seeds = np.arange(tries * bins, dtype=np.uint64) + np.uint64(0xA5A5_0001)
    return (mixed(seeds * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def densify(bins: np.ndarray) -> None:
    """Fills the empty bins of each row that has a full one: an empty bin asks bin after bin, in an order of its own that
    all texts share, and takes the first full one's value. After all tries it takes the next full bin around."""
    full = bins != _EMPTY
    donors = _donors(bins.shape[1])
    row, column = np.nonzero(~full & full.any(axis=1)[:, None])
    for ask in donors:
        if not len(row):
            return
        donor = ask[column]
        found = full[row, donor]
        bins[row[found], column[found]] = bins[row[found], donor[found]]
        row, column = row[~found], column[~found]
    donor = column.copy()
    open_ = np.arange(len(row))
    while len(open_):
        donor[open_] = (donor[open_] + 1) % bins.shape[1]
        open_ = open_[~full[row[open_], donor[open_]]]
    bins[row, column] = bins[row, donor]


def signatures(text: pa.Array, bins: int = BINS, low: int = LOW, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Per text the low bits of its densified bins' smallest hashes (uint8, a row a text), and whether it has a word.

    Each shingle is hashed once; the top bits choose its bin, the rest compete in it. ``bins`` is a power of two.
    """
    if bins < 2 or bins & (bins - 1):
        raise ValueError("the number of bins must be a power of two")
    words, offsets = word_hashes(*flat(text))
    hashes, owner = shingle_hashes(words, offsets, shingle)
    shift = np.uint64(64 - (bins - 1).bit_length())
    found = np.full(len(text) * bins, _EMPTY, np.uint64)
    place = owner * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(found, place, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    found = found.reshape(len(text), bins)
    densify(found)
    return (found & np.uint64((1 << low) - 1)).astype(np.uint8), np.diff(offsets) > 0


def packed(low: np.ndarray, bits: int = LOW) -> list[str]:
    """Each row's values end to end as hexadecimal digits."""
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :]
    return [x.tobytes().hex() for x in np.packbits(planes.reshape(len(low), -1), axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, a_has: np.ndarray, b_has: np.ndarray, low: int = LOW) -> np.ndarray:
    """Estimated resemblance of pairs of rows: the share of equal values, less what chance makes equal (2 ** -low).
    Two texts without words are alike (1), such a text and another are not (0)."""
    chance = 2.0**-low
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_has & b_has, found, (a_has == b_has).astype(float))


def _buckets(docs: DataFrame, id_col: str, count: int) -> DataFrame:
    """The rows (id, text) dealt into ranges of ids, in order inside each, the first row of the next range at the end.

    The ranges come from approximate quantiles of the ids. Only range bounds and the smallest id of each range come to
    the driver, as many as there are ranges. Column _extra marks the borrowed rows.
    """
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_order"))
    bounds = sorted({int(x) for x in ids.approxQuantile("_order", [k / count for k in range(1, count)], 0.25 / count)})
    stride = max(1, int(len(bounds) ** 0.5))
    all_, coarse = F.lit(bounds), F.lit(bounds[stride - 1 :: stride])
    under = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("_order")))
    bucket = F.lit(0)
    if bounds:
        steps = under(coarse) * stride
        bucket = steps + under(F.slice(all_, steps + 1, F.lit(stride)))
    rows = ids.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.min("_order").alias("_first"))
    firsts = dict(rows.collect())
    held = sorted(firsts)
    before = {b: held[k - 1] for k, b in enumerate(held)}  # the first range's is the last
    per_bucket = lambda x: F.lit([x.get(b, 0) for b in range(len(bounds) + 1)])
    rows = docs.withColumn("_order", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn("_bucket", bucket)
    own = F.struct(F.col("_bucket").alias("_b"), F.lit(False).alias("_extra"))
    lent = F.struct(F.element_at(per_bucket(before), F.col("_bucket") + 1).alias("_b"), F.lit(True).alias("_extra"))
    is_first = F.col("_order") == F.element_at(per_bucket(firsts), F.col("_bucket") + 1)
    copies = F.explode(F.when(is_first, F.array(own, lent)).otherwise(F.array(own)))
    return rows.withColumn("_to", copies).select("*", "_to.*").drop("_to", "_bucket")


def compare_with_edits(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bins: int = BINS,
    low: int = LOW,
    shingle: int = SHINGLE,
    ranges: int | None = None,
) -> DataFrame:
    """Per row: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text less its last floor(n_chars / 4) characters, then as many of the next document's first
    characters (or all it has); next is by ascending id, and the last document's is the first. near_edited and near_next
    are the likeness of the text's fingerprint to the edited text's and to the next document's.

    Texts are shuffled once, into ranges of ids; inside a range each row meets the next one, and the first row of the
    following range is sent along. Words are runs without ASCII blanks, lower-cased in A-Z; shingles have ``shingle``
    words (a shorter text is one shingle). Null counts as empty. A text without words has the empty fingerprint, which
    is like itself (1) and unlike any other (0). Rows that tie in the id are ordered by a hash of the text; a null id
    comes first. A single row is its own next document. Other columns are ignored. No rows give no rows. Ids are whole
    numbers.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    count = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _buckets(docs.select(F.col(id_col).alias("id"), text), "id", min(count * 4, RANGES))
    rows = rows.repartition(count, "_b").sortWithinPartitions("_b", "_extra", "_order", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one
        for part in chunks(batches, "text"):
            part = pa.Table.from_batches([part])
            if held is not None:
                part = pa.concat_tables([held, part]).combine_chunks()
            texts, range_, extra = part["text"].to_pylist(), part["_b"].to_pylist(), part["_extra"].to_pylist()
            own, has = signatures(part["text"].chunk(0), bins, low, shingle)
            pick = [k for k in range(len(texts) - 1) if not extra[k] and range_[k] == range_[k + 1]]
            edited = []
            for k in pick:
                n = len(texts[k]) // 4
                edited.append(texts[k][: len(texts[k]) - n] + texts[k + 1][:n])
            held = part.slice(len(texts) - 1)
            if not pick:
                continue
            other, other_has = signatures(pa.array(edited, pa.string()), bins, low, shingle)
            own_pick, after = own[pick], own[[k + 1 for k in pick]]
            has_pick, after_has = has[pick], has[[k + 1 for k in pick]]
            shown = [x if y else "" for x, y in zip(packed(own_pick, low), has_pick)]
            shown_edited = [x if y else "" for x, y in zip(packed(other, low), other_has)]
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"].combine_chunks().take(pa.array(pick)),
                    pa.array([len(texts[k]) for k in pick], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(shown),
                    pa.array(shown_edited),
                    pa.array(likeness(own_pick, other, has_pick, other_has, low)),
                    pa.array(likeness(own_pick, after, has_pick, after_has, low)),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "text", "_b", "_extra").mapInArrow(
        run,
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
    return out.withColumnRenamed("id", id_col)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, low: int = LOW, shingle: int = SHINGLE
) -> DataFrame:
    """The id and fingerprint of every row, without a shuffle.

    Null counts as empty; a text without words has the empty fingerprint. Rows that repeat get results of their own, a null
    id stays null, other columns are ignored, no rows give no rows. A very long text is hashed block by block, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found, has = signatures(part.column("text"), bins, low, shingle)
            shown = [x if y else "" for x, y in zip(packed(found, low), has)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shown)], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)
