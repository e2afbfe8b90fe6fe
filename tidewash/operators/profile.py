"""Profile of a table, column statistics and the data behind the charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import boolean_columns, data_columns, datetime_columns, nested_columns, numeric_columns
from .quantiles import as_double
from .stats import (
    NumericStats,
    batches,
    distinct_counts,
    estimated_distinct_counts,
    first_distinct,
    missing_counts,
    numeric_stats,
    value_counts,
)

CATEGORICAL_THRESHOLD = 50
HISTOGRAM_BINS = 10

_NUMBERS = ("min", "max", "mean", "std", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high")

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_percent", T.DoubleType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("distinct_count_estimated", T.BooleanType()),
        T.StructField("is_numeric", T.BooleanType()),
        T.StructField("is_datetime", T.BooleanType()),
        T.StructField("is_categorical", T.BooleanType()),
        T.StructField("semantic_type", T.StringType()),
        *[T.StructField(n, T.DoubleType()) for n in _NUMBERS],
        T.StructField("outlier_count", T.LongType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
    ]
)


def _distinct(df: DataFrame, columns: list[str], rows: int, estimate: bool) -> dict[str, int]:
    nested, counts = nested_columns(df, columns), dict.fromkeys(columns, 0)
    count = estimated_distinct_counts if estimate else distinct_counts
    for batch in batches([c for c in columns if c not in nested]):
        if batch:
            counts.update({r["column"]: min(rows, r["distinct_count"]) for r in count(df, batch).collect()})
    return counts


def profile_table(
    df: DataFrame,
    categorical_threshold: int = CATEGORICAL_THRESHOLD,
    semantic_types: Mapping[str, str] | None = None,
    order_by: str | None = None,
    distinct: str = "exact",
) -> DataFrame:
    """One row per column; the number of jobs does not depend on the number of columns.

    ``distinct`` is ``exact`` (a shuffle of the distinct values) or ``approx`` (sketches,
    flagged in the result), whatever the size of the table.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError(f"distinct is 'exact' or 'approx', not {distinct!r}")
    columns = data_columns(df)
    rows, missing = missing_counts(df, columns)
    estimated = distinct == "approx"
    unique = _distinct(df, columns, rows, estimated)
    stats = {s.column: s for s in numeric_stats(df, columns)}
    samples = first_distinct(df, columns, order_by=order_by)
    numbers = set(numeric_columns(df)) | set(boolean_columns(df))
    dates = set(datetime_columns(df))
    dtypes = dict(df.dtypes)
    table = []
    for c in columns:
        s = stats.get(c)
        numeric, date = c in numbers, c in dates
        categorical = (not numeric and not date) or unique[c] <= categorical_threshold
        table.append(
            (
                c, dtypes[c], missing[c], round(missing[c] / max(1, rows), 6),
                unique[c], estimated, numeric, date, categorical,
                (semantic_types or {}).get(c, "UNKNOWN"),
                *[getattr(s, n) if s else None for n in _NUMBERS],
                s.outlier_count if s else None,
                samples[c],
            )
        )
    return df.sparkSession.createDataFrame(table, PROFILE_SCHEMA)


COLUMN_STATS_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        *[T.StructField(n, T.DoubleType()) for n in _NUMBERS],
        T.StructField("outlier_count", T.LongType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField(
            "top_5_values",
            T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])),
        ),
        T.StructField("null_count", T.LongType()),
        T.StructField("semantic_type", T.StringType()),
    ]
)


def column_stats(df: DataFrame, semantic_types: Mapping[str, str] | None = None) -> DataFrame:
    """Numeric block or value counts for each column, as used by the charts.

    The deviation of a single value is 0 here (it is null in the profile).
    """
    columns = data_columns(df)
    types = semantic_types or {}
    stats = {s.column: s for s in numeric_stats(df, columns)}
    others = [c for c in columns if c not in stats and c not in nested_columns(df)]
    _, missing = missing_counts(df, columns)
    top: dict[str, list] = {c: [] for c in others}
    unique = dict.fromkeys(others, 0)
    if others:
        for r in value_counts(df, others).orderBy("column", "rank").collect():
            top[r["column"]].append((r["value"], r["count"]))
            unique[r["column"]] = r["unique_count"]
    table = []
    for c in columns:
        kind = types.get(c, "UNKNOWN")
        if c in stats:
            s = stats[c]
            numbers = [getattr(s, n) for n in _NUMBERS]
            if s.row_count - s.null_count == 1:
                numbers[_NUMBERS.index("std")] = 0.0
            table.append((c, "numeric", *numbers, s.outlier_count, None, None, s.null_count, kind))
        else:
            table.append((c, "categorical", *[None] * 11, unique.get(c), top.get(c), missing[c], kind))
    return df.sparkSession.createDataFrame(table, COLUMN_STATS_SCHEMA)


def overview(df: DataFrame) -> DataFrame:
    """``row_count, column_count, numeric_columns, categorical_columns``."""
    columns, numbers = data_columns(df), numeric_columns(df)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        F.lit(len(numbers)).cast("bigint").alias("numeric_columns"),
        F.lit(len(columns) - len(numbers)).cast("bigint").alias("categorical_columns"),
    )


# --- Chart data -------------------------------------------------------------
def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, gaussian: bool = False) -> DataFrame:
    """``bin, bin_start, bin_end, center, frequency`` over equal-width bins.

    Infinities lie outside every bin and are not counted. Frequencies are true counts; with
    ``gaussian`` they are the height (0-100) of the bell curve with the column's mean and
    deviation at the bin's centre.
    """
    v = as_double(df, column)
    v = F.when(F.abs(v) < float("inf"), v)
    low, high, mean, std = df.agg(F.min(v), F.max(v), F.avg(v), F.stddev_samp(v)).first()
    schema = "bin bigint, bin_start double, bin_end double, center double"
    if low is None:
        return df.sparkSession.createDataFrame([], f"{schema}, frequency bigint")
    width = (high / 2 - low / 2) / bins * 2  # halves, as the range may be too wide for a double
    starts = [low + i * width for i in range(bins)]
    edges = df.sparkSession.createDataFrame([(i, s, s + width, s / 2 + (s + width) / 2) for i, s in enumerate(starts)], schema)
    if gaussian:
        # Halves round up.
        z = (F.col("center") - mean) / (std or 1.0)
        height = F.exp(F.lit(-0.5) * z * z) * 100 if std else F.lit(50.0)
        return edges.withColumn("frequency", F.floor(height + 0.5).cast("bigint"))
    place = F.least(F.floor((v / 2 - F.lit(low / 2)) / F.lit(width / 2)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    counts = df.filter(v.isNotNull()).groupBy(place.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    return edges.join(counts, "bin", "left").fillna({"frequency": 0})


def category_shares(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Top values with their share of the shown total: ``value, count, share``."""
    shown = value_counts(df, [column], k).select("value", "count")
    total = F.sum("count").over(Window.partitionBy())  # over at most k rows
    return shown.select("value", "count", (F.col("count") / total).alias("share"))


BOX_FIELDS = ("min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")


def box_plot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Five-number summary, whiskers and outlier count; columns without quartiles left out."""
    stats: list[NumericStats] = [s for s in numeric_stats(df, columns) if s.median is not None]
    rows = [(s.column, *[getattr(s, f) for f in BOX_FIELDS], s.outlier_count) for s in stats]
    schema = "column string, " + ", ".join(f"{f} double" for f in BOX_FIELDS) + ", outlier_count bigint"
    return df.sparkSession.createDataFrame(rows, schema)
