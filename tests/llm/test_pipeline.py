"""The pipeline's stages against plain Python, each on the input that it was given."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quillcheck.llm import bpe, langid, mixing

from .corpus import SCHEMA
from .test_native import lines_kept, words
from .test_simhash import brute_components, brute_fingerprint

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(12)
    syllables = {"aa": ["ka", "to", "mi", "re", "su"], "bb": ["bru", "shtel", "ong", "vik"]}
    word = lambda lang: "".join(rng.choices(syllables[lang], k=rng.randint(1, 4)))
    rows, bodies = [], []
    for k in range(160):
        lang = rng.choice(["aa", "bb"])
        body = "\n".join(" ".join(word(lang) for _ in range(rng.randint(4, 20))) for _ in range(rng.randint(1, 8)))
        if k > 20 and k % 9 == 0:
            body = rng.choice(bodies)
        if k > 20 and k % 10 == 0:
            body = rng.choice(bodies) + " " + word(lang)
        bodies.append(body)
        rows.append((k, body, lang if k % 5 else None, rng.choice(["x", "y", None]), len(body)))
    rows += [(160, None, "aa", "x", None), (161, "123 ### 456", "aa", "x", 11), (162, "zqxj wvvw qqq zzz jjjj xxqz" * 9, None, "y", 0)]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder / "documents.parquet"))
    steps = [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, spark.read.parquet(str(folder / "documents.parquet")) if not k else steps[-1], str(folder)).write.parquet(str(folder / name))
        steps.append(spark.read.parquet(str(folder / name)))
    return [s.collect() for s in steps], steps, str(folder)


def test_columns_stay(stages):
    _, frames, _ = stages
    for frame in frames[1:-1]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_rejects_what_has_none(stages):
    rows, *_ = stages
    assert {r.doc_id for r in rows[0]} - {r.doc_id for r in rows[1]} >= {160, 161, 162}
    assert len(rows[1]) >= 155


def test_lines(stages):
    rows, *_ = stages
    before = sorted(rows[1], key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in rows[2]}
    for r, (_, removed, _, sha) in zip(before, lines_kept([r.text for r in before])):
        if r.doc_id in after:
            assert hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() == sha
            assert not removed or after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert removed


def test_near_copies(stages):
    rows, *_ = stages
    before = sorted(rows[2], key=lambda r: r.doc_id)
    roots = brute_components([brute_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in rows[3]) == [r.doc_id for k, r in enumerate(before) if roots[k] == k]


def test_mixture_takes_whole_documents(stages, spark):
    rows, frames, _ = stages
    texts = {r.doc_id: r for r in rows[3]}
    taken: dict = {}
    for r in rows[4]:
        assert r == texts[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    report = {r.doc_id: r.taken for r in mixing.mixture_report(frames[3]).collect()}
    assert taken == {k: v for k, v in report.items() if v}


def test_encoding(stages):
    rows, *_ = stages
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_same(stages, spark):
    rows, _, folder = stages
    assert sorted(map(str, pipeline.run(spark, folder).collect())) == sorted(map(str, rows[5]))


def test_columns_named_like_results_pass(spark):
    rows = [(k, "ka to mi re " * 5, "aa", "x", 0, "own", "own") for k in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("size", "score").withColumnRenamed("_text", "rate")
    kept = langid.identified_documents(docs)
    assert kept.columns == docs.columns and kept.first().score == "own"
