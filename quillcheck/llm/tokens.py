"""Token counts: the tokenizers library inside Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments
from .arrow import chunks, lengths


class Counter:
    """Token counts by one tokenizer file, in one worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = self.tokenizer.to_str()
        self.cut = segments.may_be_cut(settings)
        self.added = [x["content"] for x in json.loads(settings)["added_tokens"]]
        self.memo = segments.Memo(self._lengths)

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Where the file's settings allow it a text is cut at every boundary that no token crosses,
        and the library encodes each distinct piece once; other texts it is given whole, long ones in safe parts."""
        cuts = [segments.words(x) if self.cut and not any(a in x for a in self.added) else None for x in texts]
        self.memo.learn(cuts)
        look = self.memo.__getitem__
        out = [0 if cut is None else sum(map(look, cut)) for cut in cuts]
        left = [k for k, cut in enumerate(cuts) if cut is None]
        for places, parts in segments.batches([texts[k] for k in left], self.cut):
            for place, found in zip(places, self._lengths(parts)):
                out[left[place]] += found
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_path`` names a file of the tokenizers library, which every executor must be able to read. The library
    encodes batches balanced by bytes, and only lengths come back. If the file's settings are those that the cuts are safe
    for, texts are cut where no token crosses and each distinct piece of a task is encoded once; texts with characters
    outside the common repertoire or with an added token's string are given to the library as they are, long ones in parts
    cut at safe boundaries. By any other file texts are encoded whole. No special tokens are added, and special strings
    inside texts are handled as the library does by default. Null text counts as empty (0 bytes, 0 tokens); other columns
    are ignored; repeated rows give repeated results; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for part in chunks(batches, "text"):
            counts = count.counts([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lengths(part.column("text"))), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
