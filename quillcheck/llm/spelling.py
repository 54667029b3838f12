"""Spelling variants: words one edit apart, by a symmetric-delete join, and the form that each one leads to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrow import chunks
from .wordhash import _BACK, _BASE, mixed, powers

#: Letters of a run, once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST, MISPRINT, FACTOR = 5, 3, 97, 2
_SALTS = (np.uint64(0x51ED270B8F1D4E61), np.uint64(0xB5297A4D3F84D5A3))


def printed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misprint: int = MISPRINT) -> DataFrame:
    """A row (word) for every run of letters of every text; one run in ``misprint`` loses a character.

    With h the CRC-32 of "<id>:<run>", the run's character h % length goes if ``misprint`` divides h. A null id counts as
    empty, a null text has no runs.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(id_.alias("_id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "_id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % misprint == 0, short).otherwise(F.col("run")).alias("word"))


def counted_words(words: DataFrame, least_chars: int = LEAST_CHARS, least: int = LEAST) -> DataFrame:
    """Per distinct word of enough characters that stands often enough: word and n."""
    rows = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return rows.where(F.col("n") >= least)


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word itself and its distinct single deletions: the word's place and two hashes.

    Deleting any character of a run of equal ones gives the same string, so only the first of each run is deleted. The
    hashes come from sums over the characters, so a word of n characters costs n steps, whatever its length.
    """
    sizes = np.array([len(x) for x in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    start = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    place = np.concatenate([np.arange(len(words)), owner[at]])
    length = np.concatenate([sizes, sizes[owner[at]] - 1]).astype(np.uint64)
    up, down = powers(_BASE, len(code) + 1), powers(_BACK, len(code) + 1)
    found = []
    for salt in _SALTS:
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mixed(code * np.uint64(0x9E3779B97F4A7C15) ^ salt) * up[:-1], out=sums[1:])
        whole = (sums[ends] - sums[start]) * down[start]
        s, e = start[owner[at]], ends[owner[at]]
        less = ((sums[at] - sums[s]) + (sums[e] - sums[at + 1]) * np.uint64(_BACK)) * down[s]
        found.append(mixed(np.concatenate([whole, less]) + length * salt))
    return place, *found


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "word", 1 << 19):
        place, a, b = deletions(part.column("word").to_pylist())
        rank = part.column("rank").to_numpy(zero_copy_only=False)[place]
        yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["rank", "a", "b"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (lo, hi) of ranks, lo under hi, of words that differ by one inserted, deleted or replaced character.

    Two such words share a string among themselves and their single deletions, and only one, so no pair comes twice. A
    string is shared by the few words that one inserted character makes of it. What meets by it, as two hashes, is at
    most two edits apart; the words themselves then decide.
    """
    keys = words.select("rank", "word").mapInArrow(_emit, "rank long, a long, b long")
    left, right = keys.select(F.col("rank").alias("lo"), "a", "b"), keys.select(F.col("rank").alias("hi"), "a", "b")
    met = left.join(right, ["a", "b"]).where("lo < hi").select("lo", "hi")
    named = lambda r, w: words.select(F.col("rank").alias(r), F.col("word").alias(w))
    met = met.join(named("lo", "_x"), "lo").join(named("hi", "_y"), "hi")
    return met.where(F.levenshtein("_x", "_y", 1) == 1).select("lo", "hi")


def roots(forms: DataFrame) -> DataFrame:
    """From (rank, parent) without circles to (rank, root). Every round doubles the steps that a row has taken."""
    rows = cut(forms.select("rank", F.col("parent").alias("root")))
    while True:
        following = rows.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        step = rows.join(following, "root", "left").select("rank", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        step = cut(step)
        rows = step.select("rank", "root")
        if step.where("moved").isEmpty():
            return rows


def spelling_groups(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Per row (word, n) of distinct words: word, form, root, n, n_near, form_n.

    near are the words one edit away (characters are code points); the form is the near word of largest n (ties: the first
    in the order of code points) if that is ``factor`` times the word's n or more, else null. The root is where forms lead
    from the word, itself if it has none; n grows along them, so they end. Words are ranked by n and order first, so that
    only ranks are shuffled and the best near word is the least rank. No words give no rows. Words of any length are
    taken; a null word or n is left out.
    """
    words = counts.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n"))
    words = cut(words.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()))
    near = near_words(words)
    near = near.select(F.explode(F.array(*[F.struct(F.col(a).alias("rank"), F.col(b).alias("other")) for a, b in ("lo hi".split(), "hi lo".split())])).alias("_p"))
    near = cut(near.groupBy("_p.rank").agg(F.count("*").alias("n_near"), F.min("_p.other").alias("best")))
    named = lambda r, *more: words.select(F.col("rank").alias(r), *more)
    best = named("best", F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = words.join(near, "rank", "left").join(best, "best", "left")
    enough = F.col("form_n") >= factor * F.col("n")
    found = cut(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(enough, F.col(c)).alias(c) for c in ("best", "form", "form_n")]))
    ends = roots(found.where("best is not null").select("rank", F.col("best").alias("parent")))
    ends = ends.join(named("root", F.col("word").alias("_root")), "root").select("rank", "_root")
    out = found.join(ends, "rank", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spelling groups of the words of all whole texts. Repeated rows count as often as they stand; null and empty
    texts have no words; a null id counts as empty; other columns are ignored; no rows give no rows."""
    return spelling_groups(counted_words(printed_words(docs, id_col, text_col)))
