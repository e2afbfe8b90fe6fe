import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewash.operators.missing import (
    dedupe_rows,
    dedupe_subset,
    drop_empty_columns,
    fit_imputation,
    impute,
    normalise_missing,
    trim_strings,
)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name, order="_row_id"):
    return [r[name] for r in (df.orderBy(order) if order in df.columns else df).collect()]


def test_median_and_mode(spark):
    df = frame(spark, [(0, 1.0, "a"), (1, None, None), (2, 3.0, "a")], "_row_id long, num double, cat string")
    found = fit_imputation(df)
    assert column(found.apply(df), "num") == [1.0, 2.0, 3.0]
    assert column(found.apply(df), "cat") == ["a", "a", "a"]
    assert found.filled == {"num": 1, "cat": 1} and found.total == 2
    assert found.missing_after() == {"num": 0, "cat": 0}


@pytest.mark.parametrize("strategy,fill", [("mean", 8 / 3), ("median", 3.0), ("zero", 0.0), ("mode", 1.0), ("none", None)])
def test_numeric_strategies(spark, strategy, fill):
    df = frame(spark, [(0, 1.0), (1, None), (2, 3.0), (3, 4.0)], "_row_id long, num double")
    got = column(impute(df, strategy), "num")
    assert got == [1.0, pytest.approx(fill) if fill is not None else None, 3.0, 4.0]


def test_whole_numbers_are_promoted_only_by_a_fraction(spark):
    df = frame(spark, [(0, 1), (1, None), (2, 2)], "_row_id long, n long")
    assert dict(impute(df, "zero").dtypes)["n"] == "bigint"
    assert dict(impute(df, "mode").dtypes)["n"] == "bigint"
    assert column(impute(df, "median"), "n") == [1.0, 1.5, 2.0]
    assert column(impute(df, "fixed", fixed_numeric=7), "n") == [1, 7, 2]


def test_categorical_strategies_and_ties(spark):
    df = frame(spark, [(0, "b"), (1, "a"), (2, None)], "_row_id long, c string")
    assert column(impute(df), "c") == ["b", "a", "a"]
    assert column(impute(df, categorical="unknown"), "c") == ["b", "a", "Unknown"]
    assert column(impute(df, categorical="none"), "c") == ["b", "a", None]
    assert column(impute(df, categorical="fixed", fixed_categorical="z"), "c") == ["b", "a", "z"]
    empty = frame(spark, [(0, None)], "_row_id long, c string")
    assert column(impute(empty), "c") == ["Unknown"]


def test_booleans_by_mode_and_dates_left_alone(spark):
    df = frame(spark, [(0, True, None), (1, None, None), (2, True, None)], "_row_id long, b boolean, d timestamp_ntz")
    got = impute(df)
    assert column(got, "b") == [True, True, True] and column(got, "d") == [None] * 3
    assert column(impute(df, categorical="unknown"), "b") == ["True", "Unknown", "True"]


def test_nan_counts_as_missing(spark):
    df = frame(spark, [(0, 1.0), (1, float("nan")), (2, 3.0), (3, float("inf"))], "_row_id long, v double")
    found = fit_imputation(df)
    assert found.missing == {"v": 1} and column(found.apply(df), "v")[1] == 3.0
    assert column(normalise_missing(df), "v") == [1.0, None, 3.0, float("inf")]


def test_bad_strategies(spark):
    df = frame(spark, [(1.0,)], "v double")
    for bad in ({"numeric": "guess"}, {"categorical": "median"}, {"numeric": "fixed"}, {"categorical": "fixed"}):
        with pytest.raises(ValueError):
            fit_imputation(df, **bad)


def test_dedupe_rows_keeps_the_first(spark):
    df = frame(spark, [(0, 1, "x"), (1, 1, "x"), (2, 2, "y"), (3, None, None), (4, None, None)], "_row_id long, a int, b string")
    assert column(dedupe_rows(df), "_row_id") == [0, 2, 3]
    assert dedupe_rows(df.drop("_row_id")).count() == 3


def test_dedupe_subset(spark):
    df = frame(spark, [(0, 1, "x"), (1, 1, "y"), (2, None, "y"), (3, None, "z")], "_row_id long, a int, b string")
    assert column(dedupe_subset(df, ["a"]), "b") == ["x", "y"]
    assert column(dedupe_subset(df, "all"), "_row_id") == [0, 1, 2, 3]
    assert sorted(column(dedupe_subset(df.drop("_row_id"), "a"), "b")) == ["x", "y"]


def test_trim_and_empty_columns(spark):
    df = frame(spark, [(0, "  hello  ", None, 1), (1, " world\t", None, 2), (2, None, None, 3)], "_row_id long, s string, e string, v int")
    assert column(trim_strings(df), "s") == ["hello", "world", None]
    assert drop_empty_columns(df).columns == ["_row_id", "s", "v"]
    assert drop_empty_columns(df, threshold=0.3).columns == ["_row_id", "v"]


cells = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.sampled_from(["a", "b", " ", "NA"]))),
    min_size=1, max_size=25,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=cells)
def test_cleaning_properties(spark, rows):
    df = normalise_missing(frame(spark, [(i, *r) for i, r in enumerate(rows)], "_row_id long, n int, s string"))
    once = dedupe_rows(df)
    assert sorted(dedupe_rows(once).collect()) == sorted(once.collect())
    assert once.count() == len({(r["n"], r["s"]) for r in df.collect()})
    filled = impute(drop_empty_columns(once))
    for c in filled.columns:
        assert filled.filter(f"{c} IS NULL").count() == 0
