from datetime import datetime

import pytest

from tidewash.functions import (
    blank_to_null,
    col,
    finite_or_null,
    null_tokens,
    number_from_pattern,
    number_with_unit,
    parse_timestamp,
    spreadsheet_text,
    standard_units,
    strip,
    to_number,
    word_count,
)


def values(spark, cells, expression, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(col("c"))).collect()]


def test_strip_removes_every_white_space_character(spark):
    assert values(spark, ["  hello  ", " world\t", " 　x y\x1f\n", "", None], strip) == ["hello", "world", "x y", "", None]


def test_blank_and_tokens(spark):
    assert values(spark, ["", " \t", " ", " a "], blank_to_null) == [None, None, None, " a "]
    tokens = ["", "NA", "N/A", "NULL", "null", "None", "none", "na", " NA "]
    assert values(spark, tokens, null_tokens) == [None] * 7 + ["na", " NA "]


@pytest.mark.parametrize(
    "text,number",
    [
        ("8GB", 8.0), ("1.83kg", 1.83), ("512GB SSD", 512.0), ("1TB HDD", 1.0), (" +2.5 kg", 2.5), (".5kg", 0.5), ("-3 m", -3.0),
        ("5 January 2024", 5.0), ("1e5x", 1.0), ("8", None), ("plain text", None), ("$5k", None), ("", None), (None, None),
    ],
)
def test_number_with_unit(spark, text, number):
    assert values(spark, [text], number_with_unit) == [number]


def test_to_number_takes_only_numbers(spark):
    good = {"1,234": 1234.0, "1 234.5": 1234.5, "1e5": 1e5, " -7 ": -7.0, "5.": 5.0, ".5": 0.5, "inf": float("inf"), "-Infinity": float("-inf")}
    bad = ["5d", "8F", "0x1p3", "nan", "", "1.2.3", "abc", "--1", "NaN", None]
    assert values(spark, list(good) + bad, to_number) == list(good.values()) + [None] * len(bad)


def test_number_from_pattern(spark):
    cells = ["about 8 GB", "GB", "16GB and 32GB", None]
    assert values(spark, cells, lambda c: number_from_pattern(c, r"(\d+)\s*GB")) == [8.0, None, 16.0, None]
    assert values(spark, ["8", "x"], lambda c: number_from_pattern(c, None)) == [8.0, None]
    assert values(spark, ["8", "x8"], lambda c: number_from_pattern(c, r"\d+")) == [8.0, None]


def test_standard_units(spark):
    cells = ["512GB", "1TB", "256GB", "128000MB", "2TB HDD", "7gb", "none"]
    assert values(spark, cells, lambda c: standard_units(c, "GB")) == [512.0, 1024.0, 256.0, 125.0, 2048.0, None, None]
    assert values(spark, ["500g", "2kg", "10lb"], lambda c: standard_units(c, "kg")) == pytest.approx([0.5, 2.0, 4.53592])
    assert values(spark, ["10cm", "3 inches", "100mm"], lambda c: standard_units(c, "inches")) == pytest.approx([3.93701, 3.0, 3.93701])
    assert values(spark, ["5 oz"], lambda c: standard_units(c, "kg", r"(\d+)\s*([a-z]+)")) == [5.0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-05", datetime(2024, 1, 5)), ("2024-1-5", datetime(2024, 1, 5)), ("2024/01/05", datetime(2024, 1, 5)),
        ("2024-01-05 10:11:12.125", datetime(2024, 1, 5, 10, 11, 12, 125000)), ("2024-01-05T10:11", datetime(2024, 1, 5, 10, 11)),
        ("01/05/2024", datetime(2024, 1, 5)), ("13/05/2024", datetime(2024, 5, 13)), ("05-03-2024", datetime(2024, 5, 3)),
        ("5 Jan 2024", datetime(2024, 1, 5)), ("January 5, 2024", datetime(2024, 1, 5)), ("Sep 30, 2023 08:00", datetime(2023, 9, 30, 8)),
        ("2024-01-05T10:00:00Z", datetime(2024, 1, 5, 10)), ("2024-01-05T10:00:00+02:00", datetime(2024, 1, 5, 8)),
        ("2024-01-05 10:00:00-05:30", datetime(2024, 1, 5, 15, 30)),
        # A wall clock that New York skips: the session zone must not matter.
        ("2024-03-10 02:30:00", datetime(2024, 3, 10, 2, 30)),
        ("2024-02-30", None), ("2024", None), ("T10:00", None), ("garbage", None), ("May", None), ("", None), (None, None),
    ],
)
def test_parse_timestamp(spark, text, expected):
    assert values(spark, [text], lambda _: parse_timestamp("c")) == [expected]


def test_words_and_spreadsheet_text(spark):
    assert values(spark, ["", "a", "a  b\tc", "x y"], word_count) == [0, 1, 3, 2]
    assert values(spark, ["a\x00b\x0bc\td\n", "x" * 40000], spreadsheet_text) == ["abc\td\n", "x" * 32767]


def test_finite_or_null(spark):
    assert values(spark, [1.0, float("nan"), float("inf"), float("-inf"), None], finite_or_null, "double") == [1.0] + [None] * 4


def test_dates_that_users_write(spark):
    texts = {
        "1/5/24": "2024-01-05 00:00:00", "05.01.2024": "2024-05-01 00:00:00", "20240105": "2024-01-05 00:00:00", "1/5/2024 3:30 PM": "2024-01-05 15:30:00",
        "5-Jan-24": "2024-01-05 00:00:00", "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00", "1/5/2024 12:05 am": "2024-01-05 00:05:00", "12/31/99": "1999-12-31 00:00:00",
        "13.2.2024": "2024-02-13 00:00:00", "5 January 2024 12:00 p.m.": "2024-01-05 12:00:00", "1/5/2024 13:30 PM": None, "1.5": None, "20241305": None, "Friday": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "d string").select("d", parse_timestamp("d").cast("string").alias("at"))
    assert {r["d"]: r["at"] for r in df.collect()} == texts
