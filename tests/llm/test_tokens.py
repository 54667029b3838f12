from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillcheck.llm import bpe, segments, tokens

from .corpus import documents, empty, texts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def odd_texts() -> list[str]:
    """Texts at the edges of the split pattern: classes, contractions, blanks, unknown scripts, special strings."""
    rng = random.Random(11)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "'s", "'LL", "'ll", "1", "23", "!", "##", "<|endoftext|>", "日本", "🙂", " ", "²", "\r\n", "\x85", "\x1c", " the", "ʰ", "́", " "]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0xA0, 0x24F), 39, 32, 10])) for _ in range(60)) for _ in range(1500)]
    return out + ["a" * 300, " " * 70, "word " * 20_000, "x" * 90_000, "日本語" * 30_000]


def test_counts_are_the_library_s(spark):
    values = texts() + odd_texts()
    library = Tokenizer.from_file(JSON)
    want = [len(x.ids) for x in library.encode_batch([v or "" for v in values], add_special_tokens=False)]
    rows = {r.doc_id: r for r in tokens.count_tokens(documents(spark, values).repartition(3), JSON).collect()}
    assert [rows[k].n_tokens for k in range(len(values))] == want
    assert [rows[k].n_bytes for k in range(len(values))] == [len((v or "").encode()) for v in values]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows.values())
    assert tokens.count_tokens(empty(spark), JSON).count() == 0


def test_only_known_settings_are_cut(monkeypatch):
    own = Tokenizer.from_file(JSON)
    assert segments.may_be_cut(own.to_str()) and segments.PATTERN == P.PATTERN
    assert segments.may_be_cut(bpe.codec(RANKS, P.PATTERN).tokenizer.to_str())
    assert not segments.may_be_cut(bpe.build_tokenizer(bpe.read_ranks(RANKS), P.PATTERN + "|x").to_str())
    own.add_special_tokens(["two words"])
    assert not segments.may_be_cut(own.to_str())
    for name in ("word_bpe_49k.json",):
        other, counter = Tokenizer.from_file(P.path(name)), tokens.Counter(P.path(name))
        other.no_truncation()
        values = [v or "" for v in texts()] + odd_texts()[:300] + ["word " * 30_000]
        assert counter.counts(values) == [len(other.encode(v, add_special_tokens=False).ids) for v in values]


def test_a_full_memo_starts_anew():
    counter = tokens.Counter(JSON)
    counter.memo.limit, counter.memo.batch = 200, 100
    values = [v or "" for v in texts()] * 2
    assert [counter.counts([v])[0] for v in values] == tokens.counter(JSON).counts(values)


def test_pieces_are_encoded_as_in_their_text():
    for value in odd_texts()[:1500]:
        pieces = segments.words(value)
        assert pieces is None or ("".join(pieces) == value and all(segments.words(p) == [p] for p in pieces))


def test_batches_are_balanced_by_bytes():
    values = ["é" * 50] * 100 + ["word " * 200_000, "", "x"]
    found = list(segments.batches(values, True, 1000))
    joined = [""] * len(values)
    for places, parts in found:
        assert sum(len(x.encode()) + 64 for x in parts[:-1]) < 1000
        for place, part in zip(places, parts):
            joined[place] += part
    assert joined == values


def test_spans_join_to_the_text():
    for value in odd_texts():
        parts = segments.spans(value, 16)
        assert "".join(parts) == value
    assert max(map(len, segments.spans("word " * 1000, 50))) < 60


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark, library):
    values = texts() + odd_texts()
    rows = {r.doc_id: r for r in bpe.round_trip(documents(spark, values), RANKS, P.PATTERN).collect()}
    for k, value in enumerate(values):
        ids = library.encode_ordinary(value or "")
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((value or "").encode()).hexdigest()
    assert bpe.round_trip(empty(spark), RANKS, P.PATTERN).count() == 0


def test_encode_with_offsets_and_decode(spark, library):
    values = texts(20) + odd_texts()[:200]
    docs = documents(spark, values)
    encoded = bpe.encode(docs, RANKS, P.PATTERN, offsets=True)
    for r in encoded.collect():
        value = values[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(value)
        assert len(r.starts) == len(r.ends) == len(r.ids)
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(value)
        for a, b, token in zip(r.starts, r.ends, r.ids):
            assert library.decode_single_token_bytes(token) in value[a:b].encode()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert back == {k: v or "" for k, v in enumerate(values)}
