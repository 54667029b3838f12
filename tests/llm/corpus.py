"""Small corpora for the tests: every edge that the operators must stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _text string"


def texts(n: int = 60, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijé", k=rng.randint(1, 7)))
    vocabulary = [word() for _ in range(300)]
    out: list[str | None] = [None, "", " ", "one", "two words", "three short words", "\n\n", "###", "日本語の文章です", "🙂 x"]
    shared = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(5)]
    for _ in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(lines))
            lines[at:at] = shared
        out.append("\n".join(lines))
    out += [out[20], out[20], out[21] + " more", "same words " * 400, "x" * 5000, " ".join(rng.choices(vocabulary, k=6000))]
    return out


def documents(spark: SparkSession, values: list[str | None] | None = None) -> DataFrame:
    values = texts() if values is None else values
    langs, sources = ["en", "fr", None], ["a", "b", None, "c", "a", "a"]
    rows = [
        (k, v, langs[k % 3], sources[k % 6], None if v is None else len(v), "own", "own") for k, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
