import pytest

from tidewash.operators.columns import FieldSpec
from tidewash.operators.conversion import apply_rules, apply_spec, convert_types, fit_conversions


def texts(spark, **columns):
    names = list(columns)
    rows = list(zip(range(10**6), *columns.values()))
    return spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"{n} string" for n in names))


def column(df, name):
    return [r[name] for r in df.orderBy("_row_id").collect()]


def outcome(df, **options):
    plan = fit_conversions(df, **options)
    return plan, {c.column: (c.action, c.reason, c.converted) for c in plan.conversions}


def test_unit_extraction(spark):
    """Signs, fractions without a whole part, exponents that are none, blanks and what follows the unit."""
    df = texts(spark, depth=["-3m", "+4.50 m below", "  .5   metres", "12."], flow=["7l", "7e2l/s", "90 l, at most", "l 4"])
    plan, got = outcome(df)
    assert got["depth"] == ("unit_extraction", None, 3) and got["flow"][0] == "unit_extraction"
    out = plan.apply(df)
    assert column(out, "depth") == [-3.0, 4.5, 0.5, None] and column(out, "flow")[0] == 7 and column(out, "flow")[2:] == [90, None]
    assert plan.converted_total == 3 + got["flow"][2]


def test_failures_become_null_and_shares_decide(spark):
    df = texts(spark, mixed=["unknown", "41 mm", None, "6mm wide"], few=["3 kW", "a", "b", "c"], half=["1,000", "x", "2 5", "y"], none=["a", "1", "b", "c"])
    plan, got = outcome(df)
    assert column(plan.apply(df), "mixed") == [None, 41, None, 6]
    assert got["few"][0] == "unit_extraction"  # int(0.3 * 4) = 1 is enough
    assert got["half"] == ("to_numeric", None, 2) and column(plan.apply(df), "half") == [1000.0, None, 25.0, None]
    assert got["none"] == ("none", "no_conversion_rule_matched", 0)
    assert plan.missing() == {"mixed": 2, "few": 3, "half": 2, "none": 0}


def test_dates_and_their_protection(spark):
    df = texts(spark, d=["2024-01-05", "01/06/2024", "x"], long=["5 January 2024", "6 March 2024", "7 May 2024"])
    _, got = outcome(df)
    assert got["d"] == ("to_datetime", None, 2) and got["long"][0] == "unit_extraction"
    assert outcome(df, protect_dates=True)[1]["long"] == ("to_datetime", None, 3)


def test_disabled_empty_and_typed(spark):
    df = spark.createDataFrame([(1, "40 dB", None), (2, "52 dB", None)], "n long, s string, e string")
    assert outcome(df, convert=False)[1]["s"] == ("skipped", "convert_types_disabled", 0)
    assert convert_types(df, convert=False).schema == df.schema
    got = outcome(df)[1]
    assert got["n"] == ("none", "already_numeric", 0) and got["e"] == ("none", "empty", 0)


def test_reader_types(spark):
    df = texts(spark, i=["1", " -2", None], f=["1", "2.5", "inf"], b=["True", "false", None], s=["x", "y", "z"], big=["1", "99999999999999999999", "3"])
    plan, got = outcome(df, read_types=True)
    assert [got[c][0] for c in ("i", "f", "b")] == ["read_integer", "read_float", "read_boolean"]
    assert got["big"][0] == "read_float" and got["s"][0] == "none"
    out = plan.apply(df)
    assert column(out, "i") == [1, -2, None] and column(out, "b") == [True, False, None]


SPEC = {
    "schema": {
        "fields": {
            "Ram": {"type": "numeric", "unit": "GB", "pattern": r"(\d+)\s*GB"},
            "Memory": {"type": "numeric", "unit": "GB", "pattern": r"(\d+)\s*(GB|TB|MB)", "unit_standardization": True},
            "Price": {"type": "numeric"},
            "Company": {"type": "categorical"},
        }
    }
}


def test_spec_driven(spark):
    df = texts(spark, Ram=["8 GB", "x", "16GB"], Memory=["512GB", "1TB", "128000MB"], Price=["$500", "1", "3"], Company=["8GB", "8GB", "8GB"])
    out, plan = apply_spec(df, SPEC)
    assert column(out, "Ram") == [8, 12, 16]  # the gap takes the mean
    assert column(out, "Memory") == [512, 1024, 125] and column(out, "Price") == [2, 1, 3]
    assert column(out, "Company") == ["8GB"] * 3
    assert {c.column: (c.unit, c.converted) for c in plan.conversions} == {"Ram": ("GB", 2), "Memory": ("GB", 3), "Price": ("unknown", 2)}
    assert column(apply_spec(df, SPEC, fill_after_extract=False)[0], "Ram") == [8, None, 16]
    assert FieldSpec.parse(SPEC["schema"]).fields.keys() == FieldSpec.parse(SPEC).fields.keys()


def test_rules(spark):
    df = texts(spark, Ram=["8GB", "none", "16GB"], Other=["1", "2", "3"])
    out, plan = apply_rules(df, {"Ram": {"regex": r"(\d+)", "unit": "GB"}, "absent": {"regex": r"(\d+)"}})
    assert column(out, "Ram") == [8, 12, 16] and column(out, "Other") == ["1", "2", "3"]
    assert plan.conversions[0].action == "rule_extraction" and plan.conversions[0].converted == 2


def test_kept_plan_applies_to_other_tables(spark):
    plan = fit_conversions(texts(spark, v=["8GB", "9GB"]))
    assert column(plan.apply(texts(spark, v=["10GB", "?"])), "v") == [10, None]
    assert plan.table(spark).filter("action = 'unit_extraction'").first()["after_dtype"] == "double"


@pytest.mark.parametrize("names", [["a.b", "c d"], ["back`tick", "x"]])
def test_odd_names(spark, names):
    df = spark.createDataFrame([("8GB", "2024-01-01")], names)
    assert [type(v).__name__ for v in convert_types(df).first()] == ["float", "datetime"]


def test_dates_are_parsed_only_where_they_decide(spark, monkeypatch):
    from tidewash.operators import conversion

    df = spark.createDataFrame([("1", "true", "8GB", "R", "5 a"), ("2", "false", "9GB", "2024-01-05", "May be")], "i string, b string, u string, t string, few string")
    parsed, parse = [], conversion.parse_timestamp
    monkeypatch.setattr(conversion, "parse_timestamp", lambda name, *a, **b: parsed.append(name) or parse(name, *a, **b))
    plan = fit_conversions(df.select("i", "b", "u"), read_types=True)
    assert not parsed and [c.action for c in plan.conversions] == ["read_integer", "read_boolean", "unit_extraction"]
    # One of two cells is a date, which is enough; cells that only start like dates are not.
    plan = fit_conversions(df.select("t", "few"))
    assert [(c.action, c.converted) for c in plan.conversions] == [("to_datetime", 1), ("unit_extraction", 1)] and len(parsed) == 1


def test_ends_of_long_texts_decide_like_whole_ones(spark):
    from pyspark.sql import functions as F

    from tidewash.functions import parse_timestamp

    cells = ["January 5, 2024" + " " * 30 + "10:00:00 p.m.", "2024-01-05" + " " * 40 + "3:04 AM", "Wednesday,    5 January 2024", "x" * 50 + " 10:00 pm", "May " + "y" * 40, "12:00 am " + "z" * 20]
    df = spark.createDataFrame([(c,) for c in cells], "d string")
    got = [r[0] for r in df.select(F.date_format(parse_timestamp("d"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-05 22:00", "2024-01-05 03:04", "2024-01-05 00:00", None, None, None]
