"""Numerals as the reference nests them."""

import random

from pyspark.sql import functions as F

from phrasewright.functions import text as X

CASES = {
    "一万亿": 10**12, "亿": 10**8, "万": 10**4, "万五": 15_000, "亿三": 130_000_000, "3万5": 35_000, "3 亿 5": 350_000_000, "三万零五": 30_005,
    "一千零十": 1010, "十十": 20, "十五": 15, "一亿二千万": 120_000_000, "两万两千": 22_000, "+12": 12, "-7": -7, " 三 ": 3, "一二三": 123,
    "九万亿亿亿": None, "二三": 3, "一百余三": 103, "一万二万": 120_000_000, None: None,
}
DECIMALS = {"三点一四": "3.14", "二〇二四": "2024", "三四十": "30-40", "一百": "100", "": None, "十点5": "10.5", "九万亿亿亿点一": None}


def test_nested_numerals(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", X.numeral_value("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == CASES
    rows = spark.createDataFrame([(t,) for t in DECIMALS], "t string").select("t", X.decimal_text("t").alias("n")).collect()
    assert {r.t: r.n for r in rows} == DECIMALS
    assert spark.range(1).select(X.under_ten_thousand(F.lit("一千零十"))).first()[0] == 1010


def test_whole_numbers_round_trip(spark):
    rnd = random.Random(2)
    numbers = [0, 5, 10, 35_000, 30_005, 10_000, 10**8, 10**8 + 3, 10**8 + 30_000, 10**12 - 1] + [rnd.randrange(10 ** rnd.randint(1, 12)) for _ in range(500)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", X.numeral_value(X.whole_numerals_of("n")).alias("back")).collect()
    assert all(r.n == r.back for r in rows)
