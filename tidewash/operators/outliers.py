"""Outliers by the interquartile range: values outside [q1 - k·iqr, q3 + k·iqr]."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ROW_ID
from ..functions import col
from .columns import data_columns, numeric_columns, dense_row_id
from .quantiles import exact_quantiles
from .stats import IQR_FACTOR, batches, iqr_bounds, outside

Limits = Mapping[str, tuple[float | None, float | None]]

LONG_SCHEMA = "column string, row_id bigint, value double"


def outlier_limits(df: DataFrame, columns: Sequence[str] | None = None, k: float = IQR_FACTOR) -> dict:
    """Bounds of each numeric column; ``(None, None)`` for one without values.

    Names that are unknown or not numeric are ignored; no names means all columns.
    """
    found = {}
    for batch in batches(numeric_columns(df, columns or None)):
        if batch:
            found.update({c: iqr_bounds(q, k) for c, q in exact_quantiles(df, batch, (0.25, 0.75)).items()})
    return found


def limits_table(df: DataFrame, columns: Sequence[str] | None = None, k: float = IQR_FACTOR) -> DataFrame:
    """``column, lower_bound, upper_bound``."""
    rows = [(c, low, high) for c, (low, high) in outlier_limits(df, columns, k).items()]
    return df.sparkSession.createDataFrame(rows, "column string, lower_bound double, upper_bound double")


def _tests(df: DataFrame, limits: Limits) -> dict[str, Column]:
    return {c: outside(df, c, low, high) for c, (low, high) in limits.items()}


def any_outlier(df: DataFrame, limits: Limits) -> Column:
    """Test for a row with an outlier in any of the columns (null where a value is missing)."""
    return reduce(lambda a, b: a | b, _tests(df, limits).values(), F.lit(False))


def detect_outliers(
    df: DataFrame, row_id: str = ROW_ID, columns: Sequence[str] | None = None,
    k: float = IQR_FACTOR, limits: Limits | None = None,
) -> DataFrame:
    """One row per outlying cell: ``column, row_id, value``; one scan for all columns."""
    columns = [c for c in numeric_columns(df, columns or None) if c != row_id]
    limits = outlier_limits(df, columns, k) if limits is None else limits
    if not limits:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    cells = F.array(
        *[
            F.when(test, F.struct(F.lit(c).alias("column"), col(row_id).cast("bigint").alias("row_id"), col(c).cast("double").alias("value")))
            for c, test in _tests(df, limits).items()
        ]
    )
    return df.filter(any_outlier(df, limits)).select(F.inline(F.filter(cells, lambda x: x.isNotNull())))


def outlier_rows(df: DataFrame, columns: Sequence[str] | None = None, k: float = IQR_FACTOR, limits: Limits | None = None) -> DataFrame:
    """Whole rows with an outlier, tagged with ``outlier_columns``."""
    limits = outlier_limits(df, columns, k) if limits is None else limits
    tags = F.array(*[F.when(test, F.lit(c)) for c, test in _tests(df, limits).items()]).cast("array<string>")
    return df.filter(any_outlier(df, limits)).withColumn("outlier_columns", F.filter(tags, lambda x: x.isNotNull()))


def outlier_rows_by_column(df: DataFrame, columns: Sequence[str] | None = None, k: float = IQR_FACTOR) -> dict[str, DataFrame]:
    """For each numeric column, the (unevaluated) rows where it is outlying."""
    return {c: df.filter(test) for c, test in _tests(df, outlier_limits(df, columns, k)).items()}


def remove_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, k: float = IQR_FACTOR, limits: Limits | None = None, renumber: bool = False
) -> DataFrame:
    """Drop rows outlying in any chosen column; bounds come from the whole table, once.

    ``renumber`` gives the rows that stay the ``_row_id`` 0, 1, 2, … in their order.
    """
    limits = outlier_limits(df, columns, k) if limits is None else limits
    kept = df.filter(~F.coalesce(any_outlier(df, limits), F.lit(False)))
    return dense_row_id(kept) if renumber else kept


def removal_counts(df: DataFrame, columns: Sequence[str] | None = None, k: float = IQR_FACTOR, limits: Limits | None = None) -> DataFrame:
    """``rows_removed, original_rows, cleaned_rows`` of ``remove_outliers``."""
    limits = outlier_limits(df, columns, k) if limits is None else limits
    counts = df.agg(F.count_if(any_outlier(df, limits)).alias("rows_removed"), F.count(F.lit(1)).alias("original_rows"))
    return counts.withColumn("cleaned_rows", F.col("original_rows") - F.col("rows_removed"))


def outlier_summary(
    df: DataFrame, row_id: str = ROW_ID, columns: Sequence[str] | None = None,
    k: float = IQR_FACTOR, samples: int = 5,
) -> DataFrame:
    """Per numeric column: count, total, percentage and the first few outliers.

    ``column, outlier_count, total_count, percentage, sample_values, sample_indices``.
    """
    columns = [c for c in numeric_columns(df, columns or None) if c != row_id]
    limits = outlier_limits(df, columns, k)
    spark = df.sparkSession
    cells = detect_outliers(df, row_id, columns, k, limits)
    first = Window.partitionBy("column").orderBy("row_id")
    heads = (
        cells.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= samples)  # each task keeps its first few before the shuffle
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("head"))
    )
    tests = _tests(df, limits)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values())])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("outlier_count")) for i, c in enumerate(tests)]
    if not entries:
        return spark.createDataFrame(
            [], "column string, outlier_count bigint, total_count bigint, percentage double, "
            "sample_values array<double>, sample_indices array<bigint>",
        )
    totals = counts.select("n", F.inline(F.array(*entries)))
    percentage = F.round(F.when(F.col("n") > 0, F.col("outlier_count") / F.col("n") * 100).otherwise(0.0), 2)
    return totals.join(heads, "column", "left").select(
        "column",
        "outlier_count",
        F.col("n").alias("total_count"),
        percentage.alias("percentage"),
        F.coalesce(F.col("head.value"), F.array().cast("array<double>")).alias("sample_values"),
        F.coalesce(F.col("head.row_id"), F.array().cast("array<bigint>")).alias("sample_indices"),
    )


def outlier_overview(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Sizes reported next to the summary; counts rows, no other work."""
    return {
        "total_rows": df.count(),
        "total_columns": len(data_columns(df)),
        "numeric_columns_analyzed": len(numeric_columns(df, columns or None)),
    }
