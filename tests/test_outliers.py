from tidewash.operators.outliers import (
    detect_outliers,
    outlier_limits,
    outlier_overview,
    outlier_rows,
    outlier_rows_by_column,
    outlier_summary,
    removal_counts,
    remove_outliers,
)


def table(spark):
    rows = [(0, 1, 5, "x"), (1, 2, 6, "y"), (2, 3, 7, "z"), (3, 4, 8, "w"), (4, 100, 9, "v")]
    return spark.createDataFrame(rows, "_row_id long, A long, B long, C string")


def test_detection_and_rows(spark):
    df = table(spark)
    assert outlier_limits(df) == {"A": (-1.0, 7.0), "B": (3.0, 11.0)}
    assert [tuple(r) for r in detect_outliers(df).collect()] == [("A", 4, 100.0)]
    assert [(r["A"], r["outlier_columns"]) for r in outlier_rows(df).collect()] == [(100, ["A"])]
    by_column = outlier_rows_by_column(df)
    assert by_column["A"].first()["C"] == "v" and by_column["B"].count() == 0


def test_removal(spark):
    df = table(spark)
    assert [r["A"] for r in remove_outliers(df).orderBy("_row_id").collect()] == [1, 2, 3, 4]
    assert remove_outliers(df, ["B", "C", "absent"]).count() == 5
    assert remove_outliers(df, []).count() == 4
    assert remove_outliers(df, k=1000).count() == 5
    assert tuple(removal_counts(df).first()) == (1, 5, 4)


def test_missing_values_are_never_outliers(spark):
    rows = [(i, float(v) if v is not None else None, None) for i, v in enumerate([1, 2, 3, 4, 100, None, float("nan")])]
    df = spark.createDataFrame(rows, "_row_id long, v double, empty double")
    assert remove_outliers(df).count() == 6
    assert [r["row_id"] for r in detect_outliers(df).collect()] == [4]


def test_summary(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("id AS _row_id", "CASE WHEN id % 100 = 7 THEN 1e6 + id ELSE id END AS v", "'x' AS s", "id % 10 AS calm")
    got = {r["column"]: r for r in outlier_summary(df).collect()}
    assert (got["v"]["outlier_count"], got["v"]["total_count"], got["v"]["percentage"]) == (10, 1000, 1.0)
    assert got["v"]["sample_indices"] == [7, 107, 207, 307, 407] and got["v"]["sample_values"][0] == 1000007.0
    assert got["calm"]["outlier_count"] == 0 and got["calm"]["sample_values"] == []
    assert outlier_overview(df) == {"total_rows": 1000, "total_columns": 3, "numeric_columns_analyzed": 2}
    assert outlier_summary(df.select("_row_id", "s")).count() == 0
