from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from quillcheck.llm import langid

from .corpus import SCHEMA, documents, empty


def test_automaton_finds_longest_matches():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choices("abc", k=rng.randint(1, 60)))
        automaton = langid.SuffixAutomaton(text)
        for _ in range(20):
            probe = "".join(rng.choices("abcd", k=rng.randint(0, 30)))
            n, at = 0, 0
            while at < len(probe):
                size = 0
                while at + size < len(probe) and probe[at : at + size + 1] in text:
                    size += 1
                at += max(1, size)
                n += 1
            # an unknown character is a phrase of its own
            assert automaton.phrases(probe) == n


def _languages(spark, n=240):
    rng = random.Random(9)
    alphabets = {"aa": ["ka", "to", "mi", "re"], "bb": ["bru", "shtel", "ong"], "cc": ["é", "lou", "vre"]}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(alphabets))
        words = ["".join(rng.choices(alphabets[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((k, " ".join(words).title(), lang if k % 7 else None, "s", 0, lang, ""))
    rows += [(n, None, "aa", None, 0, "", ""), (n + 1, "12 ## ½²", "aa", None, 0, "", ""), (n + 2, "ka" * 9000, "aa", "s", 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows, alphabets


def test_held_out_accuracy(spark):
    docs, rows, _ = _languages(spark)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(found) == len(rows)
    right = total = 0
    for k, *_, true, _ in rows[:240]:
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        if found[k].held_out:
            right += found[k].lang_pred == true
            total += 1
        assert 0 <= found[k].score <= 1
    assert total > 40 and right / total > 0.95
    assert found[240].lang_pred == found[241].lang_pred == "und"
    assert found[242].lang_pred == "aa"


def test_held_out_rows_teach_nothing(spark):
    docs, _, _ = _languages(spark)
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("bb")).otherwise(F.col("lang")))
    assert sorted(map(str, langid.identify(docs).collect())) == sorted(map(str, langid.identify(changed).collect()))


def test_edges(spark):
    assert langid.identify(empty(spark)).count() == 0
    nothing = documents(spark, ["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
    docs, rows, _ = _languages(spark)
    kept = langid.identified_documents(docs.union(docs))
    assert kept.columns == docs.columns and kept.count() == 2 * (len(rows) - 2)


def _greedy(word: str, text: str) -> int:
    """Phrases of a word when each is the longest piece of it that stands in the text."""
    n = at = 0
    while at < len(word):
        size = 1
        while at + size < len(word) and word[at : at + size + 1] in text:
            size += 1
        at += size
        n += 1
    return n


def test_predictions_by_brute_force(spark):
    docs, rows, _ = _languages(spark, 120)
    samples = dict(langid.labelled_sample(docs, "doc_id", "text", "lang"))
    learned = {}
    for lang, parts in samples.items():
        words = [w for x in parts for w in langid.WORD.findall(x.lower())]
        cut = len(words) * 3 // 4
        text, held = f" {' '.join(words[:cut])} ", words[cut:]
        learned[lang] = text, sum(_greedy(f" {w} ", text) for w in held) / sum(len(w) + 2 for w in held)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    for k, value, *_ in rows:
        words = langid.WORD.findall((value or "").lower())
        if not any(c.isalpha() for w in words for c in w) or len(words) == 1:
            continue
        size = sum(len(w) + 2 for w in words)
        rates = {lang: sum(_greedy(f" {w} ", text) for w in words) / size / rate for lang, (text, rate) in learned.items()}
        best, second = sorted(rates.values())[:2]
        assert rates[found[k].lang_pred] == best
        assert abs(found[k].score - (1 - best / second)) < 1e-9 and abs(found[k].rate - best) < 1e-9


def test_unlearned_languages_of_the_same_script_go(spark):
    docs, rows, alphabets = _languages(spark)
    rng = random.Random(4)
    letters = sorted({c for parts in alphabets.values() for p in parts for c in p})
    other = [(1000 + k, " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(60)), None, "s", 0, "", "") for k in range(20)]
    short = [(2000 + k, " ".join("".join(rng.choices(alphabets["bb"], k=2)) for _ in range(3)), None, "s", 0, "", "") for k in range(20)]
    kept = {r.doc_id for r in langid.identified_documents(docs.union(spark.createDataFrame(other + short, SCHEMA))).collect()}
    assert kept == {r[0] for r in rows} - {240, 241} | {r[0] for r in short}
