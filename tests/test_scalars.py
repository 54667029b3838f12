from __future__ import annotations

import datetime as dt
import random
from itertools import combinations

from pyspark.sql import functions as F

from quillcheck.functions import calendar, numbers, stats
from quillcheck.functions.text import words_in_order


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k")
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in rows.select(*columns).collect()]


def test_digits_of_other_scripts(spark):
    texts = ["١٢٣", "１，２３４．５０", "12 ๓", "none", None, "৫"]
    assert values(spark, texts, numbers.fold_digits("x")) == ["123", "1,234.50", "12 3", "none", None, "5"]
    assert values(spark, texts, numbers.digit_script("x")) == ["arabic", "full width", "mixed", None, None, "bengali"]


def test_decimal_marks(spark):
    texts = ["1,234.50 and 7", "1.234,50", "1.50 or 1,50", "1,234", "1.234", "no", "1,234,567", ""]
    assert values(spark, texts, numbers.decimal_mark(numbers.number_tokens("x"))) == ["point", "comma", "mixed", None, None, None, "point", None]


def test_swaps_codes_and_adjustments(spark):
    assert values(spark, ["1223", "1", "", "11", None], numbers.adjacent_swaps("x")) == [["1232", "2123"], [], [], [], None]
    assert values(spark, [" usd", "EURO", "1$", None], numbers.currency_code("x")) == ["USD", None, None, None]
    assert values(spark, ["widget 2 @ 3", "less 5%", "Discount", "recredited", "refund -5.00", "(4.00)", "a-5"], numbers.adjusted("x")) == [False, True, True, False, True, True, False]


def test_days_and_offsets(spark):
    assert values(spark, ["+05:30", "-0800", "Z", "+14:01", "5", "+05:75", None], calendar.offset_minutes("x")) == [330, -480, 0, None, None, None, None]
    assert values(spark, ["2024-02", "2023-13", "2023-2", None], calendar.month_end("x")) == [dt.date(2024, 2, 29), None, None, None]
    day = F.col("x").cast("date")
    found = values(spark, ["2024-12-31", "2024-01-01"], *[calendar.next_period(day, u) for u in ("day", "week", "month", "quarter", "year")])
    assert found == [tuple([dt.date(2025, 1, 1), dt.date(2025, 1, 6), *[dt.date(2025, 1, 1)] * 3]), (dt.date(2024, 1, 2), dt.date(2024, 1, 8), dt.date(2024, 2, 1), dt.date(2024, 4, 1), dt.date(2025, 1, 1))]
    assert values(spark, ["2024-01-01 01:00:00"], calendar.local_date("x", F.lit(-61))) == [dt.date(2023, 12, 31)]


def test_zero_miss_sizes_are_the_tables(spark):
    rows = spark.createDataFrame([(0.05, 0.9, 45), (0.05, 0.95, 59), (0.01, 0.95, 299), (0.001, 0.99, 4603)], "bar double, c double, want long")
    for bar, c, want in rows.collect():
        assert spark.range(1).select(stats.zero_miss_size(F.lit(bar), c)).first()[0] == want
        assert 1 - (1 - c) ** (1 / want) <= bar < 1 - (1 - c) ** (1 / (want - 1))
    assert [spark.range(1).select(stats.zero_miss_size(F.lit(b))).first()[0] for b in (0.0, 1.0, 0.99)] == [None, None, 1]


def test_words_in_order_by_all_subsequences(spark):
    rng = random.Random(2)
    parts = lambda x: {c for n in range(len(x) + 1) for c in combinations(x, n)}
    pairs = [tuple([rng.choice("xyz") for _ in range(rng.randint(0, 6))] for _ in range(2)) for _ in range(60)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)] + [(60, None, ["x"]), (61, ["x"], None)], "k int, a array<string>, b array<string>")
    got = {r.k: r.n for r in frame.select("k", words_in_order(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {k: max(map(len, parts(a) & parts(b))) for k, (a, b) in enumerate(pairs)} | {60: None, 61: None}
