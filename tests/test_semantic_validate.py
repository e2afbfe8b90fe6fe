import pytest

from tidewash.operators.semantic import infer_semantic_types
from tidewash.operators.validate import ValidationError, find_issues, validate_table


def test_every_rule(spark):
    words = "one two three four five six"
    df = spark.range(100).selectExpr(
        "id", "concat('u', id, '@example.com') AS email", "concat('2024-01-', 1 + id % 28) AS day", "concat('+1 555 ', 10000 + id) AS phone",
        "concat('HTTPS://x.org/', id) AS link", "concat(id, '% ') AS pct", "concat('€', id) AS money", f"concat('{words}', id) AS prose",
        "concat('some short text ', id) AS varied", "concat('k', id % 5) AS low", "concat('k', id % 25) AS high", "concat('k', id) AS other",
        "CAST(NULL AS STRING) AS nothing", "id / 100 AS ratio", "id - 50.5D AS lat", "id + 20.5D AS lng", "id * 2.5D AS unit_price",
        "id % 7 AS seven", "id * 1.5D AS amount", "id % 2 = 0 AS flag", "current_date() AS made", "array(id) AS nested", "id + 1000 AS dup_range",
    ).withColumnRenamed("dup_range", "code")
    expected = {
        "id": "NUMERIC_ID", "email": "EMAIL", "day": "DATE_STRING", "phone": "PHONE_NUMBER", "link": "URL", "pct": "PERCENTAGE",
        "money": "CURRENCY", "prose": "FREE_TEXT", "varied": "FREE_TEXT", "low": "CATEGORICAL_LOW", "high": "CATEGORICAL_HIGH",
        "other": "UNKNOWN", "nothing": "UNKNOWN", "ratio": "PERCENTAGE", "lat": "LATITUDE", "lng": "LONGITUDE", "unit_price": "CURRENCY",
        "seven": "NUMERIC_CONTINUOUS", "amount": "NUMERIC_CONTINUOUS", "flag": "PERCENTAGE", "made": "DATE_STRING", "nested": "UNKNOWN",
        "code": "NUMERIC_ID",
    }
    assert infer_semantic_types(df) == expected


def test_unique_share_counts_all_rows(spark):
    """The share of different values is of all rows, the match share of the filled ones."""
    df = spark.createDataFrame([(f"k{i}" if i < 30 else None,) for i in range(100)], "c string")
    assert infer_semantic_types(df) == {"c": "CATEGORICAL_HIGH"}


def test_issues(spark):
    df = spark.createDataFrame([(1, "a", 5.0, True), (None, "b", -2.5, False)], "n long, s string, v double, b boolean")
    spec = {
        "fields": {
            "n": {"required": True, "type": "numeric", "max": 0}, "s": {"type": "numeric"}, "v": {"min": 0, "max": 4.5, "type": "datetime"},
            "b": {"type": "boolean"}, "gone": {"required": True}, "note": {"type": "categorical"},
        }
    }
    assert find_issues(df, spec) == [
        ("n", "missing values found (required field has 1 nulls)"), ("n", "value 1 exceeds maximum 0"),
        ("s", "expected numeric type, found string"), ("v", "expected datetime type, found double"),
        ("v", "value -2.5 is below minimum 0"), ("v", "value 5.0 exceeds maximum 4.5"),
        ("gone", "column not found in dataset"), ("note", "column not found in dataset"),
    ]
    assert find_issues(df, None) == [] and find_issues(df, {}) == []


def test_structure(spark):
    df = spark.createDataFrame([(1, 2, None)], "a long, b long, c long")
    fixed, renames = validate_table(df.select("a", "b").toDF("a", "a"))
    assert fixed.columns == ["a", "a_1"] and renames[0].after == "a_1"
    with pytest.raises(ValidationError, match="column 1 has no name"):
        validate_table(df.select("a", "b").toDF("a", " "))
    with pytest.raises(ValidationError, match="c"):
        validate_table(df)
    assert validate_table(df, allow_empty_columns=True)[0].columns == ["a", "b", "c"]
    with pytest.raises(ValidationError, match="without rows"):
        validate_table(df.limit(0))


def test_long_texts_need_no_dates_and_no_arrays_of_words(spark, monkeypatch):
    from tidewash.functions import word_count
    from tidewash.operators import semantic

    words = spark.createDataFrame([(" a\u2003b\x1c\n c ",), ("",), ("one",), ("\u00e9t\u00e9 \U0001f600 5",), (None,)], "s string").select(word_count(semantic.strip(semantic.col("s"))))
    assert [r[0] for r in words.collect()] == [3, 0, 1, 3, None] and "extract_all" not in words._jdf.queryExecution().toString()
    parsed, parse = [], semantic.parse_timestamp
    monkeypatch.setattr(semantic, "parse_timestamp", lambda name, *a, **b: parsed.append(name) or parse(name, *a, **b))
    df = spark.createDataFrame([("some words in a long text",), ("5 words that start with digits",)], "t string")
    assert infer_semantic_types(df) == {"t": "FREE_TEXT"} and not parsed
    assert infer_semantic_types(spark.createDataFrame([("2024-01-05",), ("May 5, 2024",)], "t string")) == {"t": "DATE_STRING"} and parsed
