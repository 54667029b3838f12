"""Byte-level BPE encoding and decoding with the tokenizers library, built from a file of ranks."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments
from .arrow import chunks


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizer whose merges are all splits of each token into two tokens, by the token's rank."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    characters = segments.byte_characters()
    name = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((name[token[:cut]], name[token[cut:]]))
    tokenizer = Tokenizer(BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    if pattern == segments.PATTERN:  # the library's own split, which is faster than the same pattern given to it
        tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
    else:
        tokenizer.pre_tokenizer = Sequence(
            [Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
    return tokenizer


class Codec:
    """Encoder and decoder of one worker process. Ids are handled as text, decimal numbers joined by one blank."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ranks = read_ranks(path)
        self.number = {rank: str(rank) for rank in ranks.values()}.__getitem__
        self.bytes_of = {b"%d" % rank: token for token, rank in ranks.items()}
        self.tokenizer = build_tokenizer(ranks, pattern)
        self.cut = segments.may_be_cut(self.tokenizer.to_str())
        self.memo = segments.Memo(self._ids)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [" ".join(map(self.number, x.ids)).encode() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the library over batches balanced by bytes: each distinct piece that no token crosses
        once; texts that only the library should cut are given to it whole, long ones in safe parts."""
        cuts = [segments.words(x) if self.cut else None for x in texts]
        self.memo.learn(cuts)
        look = self.memo.__getitem__
        out = [b"" if cut is None else b" ".join(map(look, cut)) for cut in cuts]
        left = [k for k, cut in enumerate(cuts) if cut is None]
        parts_of: list[list[bytes]] = [[] for _ in left]
        for places, parts in segments.batches([texts[k] for k in left], self.cut):
            for place, found in zip(places, self._ids(parts)):
                if found:
                    parts_of[place].append(found)
        for k, parts in zip(left, parts_of):
            out[k] = b" ".join(parts)
        return out

    def spans(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of one text with the characters each touches, [start, end); a token inside a character spans it whole."""
        ids = self.encode([text])[0].split()
        data = text.encode()
        at = [0] * (len(data) + 1)  # character of each byte
        k = -1
        for i, b in enumerate(data):
            k += (b & 0xC0) != 0x80
            at[i] = k
        at[len(data)] = k + 1
        starts, ends, place = [], [], 0
        for i in ids:
            stop = place + len(self.bytes_of[i])
            starts.append(at[place])
            ends.append(at[stop - 1] + 1)
            place = stop
        return [int(i) for i in ids], starts, ends

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; joined before any decoding to text, as a character may be split over tokens."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """The id, ids (array of int) and, if asked for, starts and ends (characters of each token) of every row's text.

    Null text counts as empty and gives no ids. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for part in chunks(batches, "text"):
            texts = [x or "" for x in part.column("text").to_pylist()]
            if offsets:
                found = [coder.spans(x) for x in texts]
                lists = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(3)]
            else:
                lists = [pa.array([[int(i) for i in x.split()] for x in coder.encode(texts)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "ids", "starts", "ends"][: 1 + len(lists)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(run, f"id {kind}, ids array<int>{more}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id, data (bytes) and text of every row's ids; text has U+FFFD where the bytes are no UTF-8. Null ids: empty.
    An id that the file does not have raises a KeyError. Repeated rows get results of their own; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            data = [coder.decode(b" ".join([b"%d" % i for i in x or ()])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(data, pa.binary()), pa.array([x.decode(errors="replace") for x in data])],
                ["id", "data", "text"],
            )

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, data binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 (of decimal ids joined by blanks) and decoded_sha256 (of the decoded bytes) per row.

    Encodes and decodes in one pass, so that no ids are stored. Null text counts as empty. Repeated rows and ids get results
    of their own, a null id stays null, other columns are ignored, no rows give no rows. Very long texts are encoded whole,
    cut only where no token crosses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for part in chunks(batches, "text"):
            found = coder.encode([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([x.count(b" ") + 1 if x else 0 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in found], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed(
        "id", id_col
    )
