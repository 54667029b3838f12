from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quillcheck.llm import fingerprints as fp

from .corpus import documents, empty, texts


def test_rows_meet_the_next_document(spark):
    values = texts()
    rows = {r.doc_id: r for r in fp.compare_with_edits(documents(spark, values).repartition(5), ranges=3).collect()}
    assert sorted(rows) == list(range(len(values)))
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(documents(spark, values)).collect()}
    for k, value in enumerate(values):
        own, after = value or "", values[(k + 1) % len(values)] or ""
        n = len(own) // 4
        edited = own[: len(own) - n] + after[:n]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[k].n_chars == len(own)
        assert rows[k].fingerprint == plain[k]
        assert 0 <= rows[k].near_edited <= 1 and 0 <= rows[k].near_next <= 1
        if own == after:
            assert rows[k].near_next == 1


def test_likeness_is_near_the_resemblance():
    rng = random.Random(3)
    errors = []
    for size in (30, 200, 1500):
        for _ in range(12):
            words = [str(rng.randint(0, 10**6)) for _ in range(size)]
            cut = rng.randint(0, size - 6)
            other = words[:cut] + [str(rng.randint(0, 10**6)) for _ in range(size - cut)]
            sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            found, has = fp.signatures(pa.array([" ".join(words), " ".join(other)]))
            errors.append(fp.likeness(found[:1], found[1:], has[:1], has[1:])[0] - true)
    assert np.abs(errors).max() < 0.16 and abs(np.mean(errors)) < 0.03


def test_edges(spark):
    assert fp.compare_with_edits(empty(spark)).count() == 0
    one = fp.compare_with_edits(documents(spark, ["a b c d e f g h"])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    same = documents(spark, ["x y z"] * 4).withColumn("doc_id", __import__("pyspark").sql.functions.lit(None).cast("long"))
    assert [r.near_next for r in fp.compare_with_edits(same).collect()] == [1.0] * 4


def test_long_texts_hash_alike_in_blocks(monkeypatch):
    from quillcheck.llm import wordhash

    data = ("word next " * 500 + "y" * 3000 + " end").encode()
    array, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    whole = wordhash.word_hashes(array, offsets)[0]
    monkeypatch.setattr(wordhash, "BLOCK", 100)
    assert (wordhash.word_hashes(array, offsets)[0] == whole).all()


def test_bins_densification_and_packing_by_plain_loops():
    """Against loops over one text at a time: hashes of shingles, the smallest in each bin, donors for empty bins, low bits."""
    from quillcheck.llm import wordhash

    bins, low = 64, 4
    values = ["", "one", "a b c d", "A b C d e f", " ".join(map(str, range(30))), "x y " * 50, " ".join(map(str, range(900)))]
    found, has = fp.signatures(pa.array(values), bins, low)
    donors = fp._donors(bins)
    for k, value in enumerate(values):
        own = [wordhash.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in value.split()]
        assert has[k] == bool(own)
        if not own:
            continue
        parts = [own[i : i + 5] for i in range(len(own) - 4)] or [own]
        hashes = [int(wordhash.shingle_hashes(np.array(x, np.uint64), np.array([0, len(x)]), 5)[0][0]) for x in parts]
        slots: list = [None] * bins
        for h in hashes:
            at, rest = h >> 58, h & (1 << 58) - 1
            slots[at] = rest if slots[at] is None else min(slots[at], rest)
        want = []
        for b in range(bins):
            value_of = slots[b]
            for ask in donors:
                if value_of is not None:
                    break
                value_of = slots[ask[b]]
            want.append(value_of & (1 << low) - 1)
        assert found[k].tolist() == want
        assert fp.packed(found[k : k + 1], low)[0] == "".join(f"{x:x}" for x in want)


def test_bins_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        fp.signatures(pa.array(["a"]), bins=500)
