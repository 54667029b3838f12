"""Quotations that are not word for word: the longest run of their words that a text holds."""

from __future__ import annotations

from itertools import batched, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import ELLIPSIS, Runs, matched
from ..functions.alignment import differences as word_differences
from ..functions.places import compared, mapped, original_span
from ..functions.text import quotable
from ..session import cut

#: Rows that are sent to all tasks at most; more meet by a shuffle. Short quotations are looked for by as many at a time.
FEW, BLOCK = 500_000, 1000
#: Inner words by which a quotation is looked up.
INNER = 5


def _windows(rows: DataFrame, key: str, text: Column, place: str, size: int) -> DataFrame:
    """One row a window of ``size`` words: key, hash, place from 1. Texts shorter than a window, and null ones, give none. No filter
    reads the words, as Spark would work out the text for it once more; each word is hashed once for all its windows."""
    words = rows.select(key, F.transform(F.split(text, " "), lambda w: F.xxhash64(w)).alias("w"))
    window = ", ".join(f"get(w, i + {k})" for k in range(size))
    hashed = F.expr(f"if(size(w) < {size}, array(), transform(sequence(0, size(w) - {size}), i -> xxhash64({window})))")
    return words.select(key, F.posexplode(hashed).alias("p", "h")).select(key, (F.col("p") + 1).alias(place), "h")


def _sent(rows: DataFrame, few: int) -> DataFrame:
    """The rows, marked to be sent to all tasks if there are few."""
    return F.broadcast(rows) if rows.count() <= few else rows


def longest_runs(docs: DataFrame, quotes: DataFrame, doc: str, quote: str, text: str = "text", size: int = 5, few: int = FEW) -> DataFrame:
    """For each text and quotation with ``size`` consecutive words in common: the longest such run, ``run`` words from word
    ``quoted_at`` of the quotation and word ``place`` of the text (of equal ones the first in the quotation, then in the text).

    Distinct windows of the quotations meet those of the texts by a hash, so a place of a text comes once a quotation however
    often the window stands in it; a text's places are then read once along the quotation's suffix automaton over the same
    hashes. Work follows the words in common, and no text is paired with a quotation that it shares nothing with. Windows of
    quotations are sent to all tasks if there are at most ``few``. The hash has 64 bits: a false hit needs a collision beside
    a true run to change a result. Null texts and quotations give nothing; ids tell rows apart.
    """
    return _runs(docs, quotes, doc, quote, quotable(text), size, few)


def _runs(docs: DataFrame, quotes: DataFrame, doc: str, quote: str, plain: Column, size: int, few: int) -> DataFrame:
    """``longest_runs`` of the words of ``plain``, a column of either frame."""
    asked = cut(_windows(quotes, quote, plain, "quoted_at", size))
    hits = _windows(docs, doc, plain, "place", size).join(_sent(asked.select(quote, "h").distinct(), few), "h")
    hits = hits.groupBy(doc, quote).agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("_hits"))
    whole = asked.groupBy(quote).agg(F.sort_array(F.collect_list(F.struct("quoted_at", "h")))["h"].alias("_all"))

    @F.pandas_udf("struct<run: int, quoted_at: int, place: int>")
    def longest(alls: pd.Series, places: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        known: tuple[bytes, Runs] = (b"", Runs(()))
        rows = []
        for whole, at, hs in zip(alls, places, hashes):
            if whole.tobytes() != known[0]:
                known = whole.tobytes(), Runs(whole.tolist())
            breaks = [0, *(np.flatnonzero(np.diff(at) != 1) + 1), len(at)]
            each = ((known[1].longest(hs[a:b].tolist(), int(at[a]) - 1)) for a, b in pairwise(breaks))
            rows.append(min(((-n, q, p) for n, q, p in each)))
        return pd.DataFrame([(size - 1 - n, q, p) for n, q, p in rows], columns=["run", "quoted_at", "place"])

    found = hits.join(whole, quote).select(doc, quote, longest("_all", F.col("_hits.place"), F.col("_hits.h")).alias("b"))
    return found.select(doc, quote, "b.run", "b.quoted_at", "b.place")


#: Signs before and after a word: no letters, digits, or signs that go with numbers.
_EDGES = r"(?<![^ ])[^\p{L}\p{N}_\u2026\u00a7$ ]+|[^\p{L}\p{N}_\u2026% ]+(?![^ ])"


def bare_words(x: Column) -> Column:
    """A text in the form of ``quotable`` without the signs at the edges of words; words of signs alone go."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, _EDGES, ""), "  +", " "))


def differences(docs: DataFrame, quotes: DataFrame, doc: str, quote: str, text: str = "text", size: int = 5, omitted: int = 50, few: int = FEW) -> DataFrame:
    """For each text and quotation with ``size`` consecutive words in common: the ``run`` of them that is longest, ``n_shared`` of the
    quotation's ``n_words`` that the passage has in order, and ``differences``, an array of (quoted_at, place, quoted, stands): where
    the words differ, the number of the first word there in either, from 1, and the words of either.

    The passage is what stands around the longest run in common, as far as the quotation goes on and a quarter (three words at
    least) further, and ``omitted`` words for each ellipsis. Words are those of ``bare_words``, and an ellipsis inside the
    quotation is counted as one; so case, line breaks, the form of quotes and dashes, and signs beside words are no differences.
    Words are aligned as in ``functions.alignment``, in Arrow batches of passages, which are no longer than their quotations
    allow. Null and empty texts and quotations give nothing; ids tell rows apart.
    """
    said = bare_words(F.regexp_replace(quotable(text), r"\.(?: ?\.){2,}", f" {ELLIPSIS} "))
    asked = quotes.select(quote, F.regexp_replace(said, f"^({ELLIPSIS} ?)+|( ?{ELLIPSIS})+$", "").alias(text))
    plain = bare_words(quotable(text))
    runs = cut(_runs(docs.select(doc, plain.alias(text)), asked, doc, quote, F.col(text), size, few))
    held = docs.join(_sent(runs.select(doc).distinct(), few), doc, "left_semi").select(doc, plain.alias(text))
    asked = asked.select(quote, F.split(text, " ").alias("_q"))
    gaps = F.size(F.filter("_q", lambda w: w == ELLIPSIS))
    slack = F.greatest(F.lit(3), F.ceil(F.size("_q") / 4)) + omitted * gaps
    start = F.col("place") - F.col("quoted_at") + 1
    low, high = F.greatest(F.lit(1), start - slack), start + F.size("_q") - 1 + slack
    near = held.select(doc, F.split(text, " ").alias("_w")).join(_sent(runs, few), doc).join(asked, quote)
    near = near.select(doc, quote, "run", "_q", low.cast("int").alias("_low"), F.slice("_w", low.cast("int"), (high - low + 1).cast("int")).alias("_p"))

    @F.pandas_udf("struct<n_shared: int, differences: array<struct<quoted_at: int, place: int, quoted: string, stands: string>>>")
    def compared(qs: pd.Series, ps: pd.Series, lows: pd.Series) -> pd.DataFrame:
        rows = []
        for q, p, low in zip(map(list, qs), map(list, ps), lows):
            found = word_differences(q, p, int(low) - 1)
            rows.append((len(matched(q, p)), [(i, j, " ".join(a), " ".join(b)) for i, j, a, b in found]))
        return pd.DataFrame(rows, columns=["n_shared", "differences"])

    return near.select(doc, quote, "run", (F.size("_q") - gaps).alias("n_words"), compared("_q", "_p", "_low").alias("c")).select(doc, quote, "run", "n_words", "c.*")


def quote_reason(run: Column, n_words: Column) -> Column:
    """verbatim: all words of the quotation; misquote: a run of them; not located: none."""
    return F.when(run.isNull(), "not located").when(run >= n_words, "verbatim").otherwise("misquote")


def verbatim(docs: DataFrame, quotes: DataFrame, doc: str, quote: str, text: str = "text", few: int = FEW) -> DataFrame:
    """Which texts hold which quotations word for word: doc, quote, ``place`` (from 1, in the form that compares), and
    ``start`` and ``end``, the first occurrence's place in the original text.

    A quotation is looked up by its inner words, the second to the sixth at most, which stand whole in any text that holds
    it; so texts give only windows of the sizes that quotations have, and where quotations are few they are sent to the
    texts and no window is shuffled. That takes built-in functions only; texts in which something is found are then mapped
    in Arrow batches, once each, and the whole quotation confirms it. Those of one or two words have no inner word: they are
    looked for in each text, BLOCK at a time. Null texts and quotations give nothing, an empty
    quotation stands at the beginning of every text; ids tell rows apart.
    """
    asked = cut(quotes.select(F.col(quote).alias("_q"), mapped(text)["text"].alias("_said"), compared(text).alias("_asked")).where("_said is not null"))
    asked = asked.withColumn("_n", F.least(F.size(F.split("_asked", " ")) - 2, F.lit(INNER)))
    texts = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_text")).where("_text is not null")
    held = texts.select("_d", compared("_text").alias("_plain"))
    sizes = sorted(r[0] for r in asked.where("_n > 0").select("_n").distinct().collect())  # INNER at most
    parts = []
    if sizes:
        keyed = asked.where("_n > 0").select("_q", F.expr("xxhash64(_n, slice(split(_asked, ' '), 2, _n))").alias("_h"))
        one = lambda n: f"if(size(w) < {n}, array(), transform(sequence(0, size(w) - {n}), i -> xxhash64({n}, slice(w, i + 1, {n}))))"
        windows = f"array_distinct(flatten(array({', '.join(map(one, sizes))})))"
        words = held.select("_d", F.split("_plain", " ").alias("w"))
        parts.append(words.select("_d", F.explode(F.expr(windows)).alias("_h")).join(_sent(keyed, few), "_h").select("_d", "_q").distinct())
    short = asked.where("_n <= 0").select("_asked").distinct().toLocalIterator()
    for block in batched((r[0] for r in short), BLOCK):
        here = F.filter(F.array(*map(F.lit, block)), lambda q: F.contains(F.col("_plain"), q))
        parts.append(held.select("_d", F.explode(here).alias("_asked")).join(asked.where("_n <= 0"), "_asked").select("_d", "_q"))
    if not parts:
        parts.append(held.join(asked, F.lit(False)).select("_d", "_q"))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = cut(pairs)
    found = texts.join(_sent(pairs.select("_d").distinct(), few), "_d", "left_semi").withColumn("_m", mapped("_text")).drop("_text")
    found = found.join(_sent(pairs, few), "_d").join(asked.select("_q", "_said"), "_q")
    found = found.withColumn("_at", F.expr("position(_said in _m.text)")).where("_at > 0")
    span = original_span(F.col("_m"), F.col("_at") - 1, F.length("_said"))
    found = found.select("_d", "_q", F.col("_at").cast("bigint").alias("place"), span.alias("_s"))
    return found.select(F.col("_d").alias(doc), F.col("_q").alias(quote), "place", "_s.start", "_s.end")
