from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import pytest

from quillcheck.llm import hostrules, linededup, mixing

from .corpus import documents, empty, texts

BLANKS = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lines_kept(values: list[str | None]) -> list[tuple[int, int, int, str]]:
    seen, out = set(), []
    for value in values:
        lines = (value or "").split("\n")
        real = [k for k, x in enumerate(lines) if x.strip(BLANKS)]
        gone, last = [], None
        for a, b, c in zip(real, real[1:], real[2:]):
            window = tuple(lines[k].strip(BLANKS) for k in (a, b, c))
            if window in seen:
                gone.append((real.index(a), a, c))
            seen.add(window)
        runs = []
        for k, a, c in gone:
            if runs and k - last <= 3:
                runs[-1][1] = c
            else:
                runs.append([a, c])
            last = k
        drop = {i for a, c in runs for i in range(a, c + 1)}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out.append((len(lines), len(drop), len(runs), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    values = texts()
    values += ["a\nb\nc\na\nb\nc\nd", " a \n\n b\nc\nx\n\ny", "a\nb", "\n".join(["same"] * 9), values[20] + "\n" + values[21]]
    rows = {r.doc_id: tuple(r)[1:] for r in linededup.line_report(documents(spark, values).repartition(4)).collect()}
    assert [rows[k] for k in range(len(values))] == lines_kept(values)
    kept = linededup.dedup_lines(documents(spark, values))
    assert set(documents(spark).columns) < set(kept.columns)
    assert kept.where("doc_id = 0").first().text is None


def test_line_dedup_edges(spark):
    docs = documents(spark)
    assert linededup.line_report(empty(spark)).count() == 0
    once = sorted(map(tuple, linededup.line_report(docs).collect()))
    assert sorted(map(tuple, linededup.line_report(docs.union(docs)).collect())) == sorted(once + once)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert linededup.line_report(nameless).count() == docs.count()


def test_columns_named_like_results_pass_or_are_refused(spark):
    rows = [(k, "a\nb\nc\nd", 10 + k, 7, 9, 8) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, N_LINES int, n_removed int, n_spans int")
    kept = linededup.deduped_documents(docs)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == rows[:1]
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs)
    longer = linededup.deduped_documents(docs.withColumn("text", F.concat("text", F.lit("\n"), "doc_id"))).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in longer] == [("a\nb\nc\nd\n0", 10), ("1", 1), ("2", 1)]


def test_statistics_and_hosts(spark):
    values = texts()
    rows = {r.doc_id: r for r in hostrules.host_quality(documents(spark, values)).collect()}
    assert len(rows) == len(values)
    for k, value in enumerate(values):
        own = words(value)
        lines = [x for x in (value or "").split("\n") if words(x)]
        windows = list(zip(own, own[1:], own[2:]))
        covered = {i + j for i, w in enumerate(windows) for j in range(3) if windows.count(w) > 1} if len(own) < 500 else None
        r = rows[k]
        assert (r.n_words, r.word_chars) == (len(own), sum(map(len, own)))
        assert r.n_symbols == sum((value or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_failed)
    repeated = values.index("same words " * 400)
    assert rows[repeated].n_repeat_words == 800


def verdicts(hosts: dict[str, tuple[int, int]], spread: float = 2.0) -> dict[str, tuple[float, bool]]:
    """Shrunk rate and verdict of each host (documents, failures) for one rule, in plain Python."""
    n = sum(d for d, _ in hosts.values())
    m = sum(f for _, f in hosts.values()) / n
    v = (sum(d * (f / d - m) ** 2 for d, f in hosts.values()) - (len(hosts) - 1) * m * (1 - m)) / n
    s = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    rates = {h: (f + m * s) / (d + s) for h, (d, f) in hosts.items()}
    return {h: (r, r > m + spread * (m * (1 - m) / (s + 1)) ** 0.5) for h, r in rates.items()}


def test_bad_hosts_fail_and_small_ones_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w{i}###" for i in range(60))
    hosts = {f"h{k:02}": (40, k % 3) for k in range(30)} | {"bad": (40, 12), "one": (1, 1), "fine": (900, 9)}
    rows = [(h, bad if k < f else good) for h, (d, f) in hosts.items() for k in range(d)]
    docs = spark.createDataFrame([(k, t, "en", h, 0, "", "") for k, (h, t) in enumerate(rows)], documents(spark, []).schema)
    want = verdicts(hosts)
    got = hostrules.host_quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.host_failed == want[rows[r.doc_id][0]][1]
    # all of the one document of a host fails, which is too little to condemn it once the rate is shrunk
    assert want["bad"][1] and not want["one"][1] and want["bad"][0] > want["one"][0]
    assert {h for h, (_, failed) in want.items() if failed} == {"bad"}
    assert not any(r.kept for r in got if rows[r.doc_id][0] == "bad") and any(r.kept for r in got)
    alike = spark.createDataFrame([(k, bad if k % 10 == 0 else good, "en", f"h{k % 7}", 0, "", "") for k in range(280)], docs.schema)
    assert not any(r.host_failed for r in hostrules.host_quality(alike).collect())
    assert hostrules.host_quality(empty(spark)).count() == 0


def fill(sizes: dict[str, int], weights: dict[str, int], cap: int = 3) -> dict[str, float]:
    """Shares by weight, capped, the excess dealt again until none is above."""
    out, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weights[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixture(spark):
    values = texts(300)
    sources = ["big"] * 7 + ["a", None, "tiny", "é", "Z", "empty"]
    rows = [(k, "" if sources[k % 13] == "empty" else v if sources[k % 13] != "tiny" else "x y", "en", sources[k % 13], 0, "", "") for k, v in enumerate(values)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema)
    got = mixing.mixture_report(docs).collect()
    assert len(got) == len(rows)
    order = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in order}
    want = fill(sizes, weights)
    taken: dict = {}
    for r in got:
        source = rows[r.doc_id][3]
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s in order:
        largest = max(len(words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= 0.1 * want[s] + largest
    assert sorted(map(str, mixing.mixture_report(docs.repartition(5)).collect())) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(docs, ["doc_id"]).collect())


def test_mixture_edges(spark):
    assert mixing.mixture_report(empty(spark)).count() == 0
    nothing = documents(spark, [None, "", " "])
    assert {(r.size, r.taken, r.target) for r in mixing.mixture_report(nothing).collect()} == {(0, 0, 0.0)}
    docs = documents(spark)
    assert mixing.mixture_report(docs.union(docs)).count() == 2 * docs.count()


def test_mixture_is_near_its_targets(spark):
    import random
    from collections import defaultdict

    rng = random.Random(12)
    values = ["w " * int(rng.paretovariate(1.1) * 5) for _ in range(900)]
    rows = [(k, v, "ABCDEFG"[min(6, int(rng.expovariate(0.7)))]) for k, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, ["doc_id", "source"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < max(r.size for r in own)
    sliced = mixing.mix(docs, ["doc_id", "source"], slice_rows=2).collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, got))
    assert sum(r.target for r in (v[0] for v in by.values())) == pytest.approx(sum(r.size for r in got))
