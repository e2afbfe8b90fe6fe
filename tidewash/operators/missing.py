"""Cleaning of cells, columns and rows: trimming, missing tokens, empty columns,
duplicate rows, imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ROW_ID
from ..functions import blank_to_null, col, finite_or_null, nan_to_null, null_tokens, strip
from ..functions.text import MISSING_TOKENS
from .columns import (
    boolean_columns,
    data_columns,
    floating_columns,
    integral_columns,
    numeric_columns,
    string_columns,
)
from .quantiles import exact_quantiles
from .stats import batches, missing_counts, missing_profile, modes, present

UNKNOWN = "Unknown"


# --- Cells ------------------------------------------------------------------
def _replace(df: DataFrame, changes: dict) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else col(c) for c in df.columns])


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _replace(df, {c: strip(col(c)) for c in string_columns(df, columns)})


def normalise_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    tokens: Sequence[str] = MISSING_TOKENS,
    trim: bool = True,
) -> DataFrame:
    """Missing tokens and NaN to null; with ``trim`` also strips, so ``"  NA "`` counts."""
    changes = {c: null_tokens(strip(col(c)) if trim else col(c), tokens) for c in string_columns(df, columns)}
    changes.update({c: nan_to_null(col(c)) for c in floating_columns(df, columns)})
    return _replace(df, changes)


def nullify_blank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _replace(df, {c: blank_to_null(col(c)) for c in string_columns(df, columns)})


def finite_only(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _replace(df, {c: finite_or_null(col(c)) for c in floating_columns(df, columns)})


# --- Columns ----------------------------------------------------------------
def sparse_columns(df: DataFrame, threshold: float = 1.0, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose share of missing cells reaches ``threshold``."""
    rows, missing = missing_counts(df, columns)
    return [c for c in data_columns(df) if c in missing and rows and missing[c] >= threshold * rows]


def drop_empty_columns(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop columns without any value, or missing in at least ``threshold`` of the rows."""
    return df.drop(*sparse_columns(df, threshold))


# --- Rows -------------------------------------------------------------------
def dedupe_rows(df: DataFrame) -> DataFrame:
    """Keep one of each group of equal rows (null equals null), the first by ``_row_id``.

    A hash aggregation: copies merge inside each task before the shuffle, so a row that
    makes up a third of the table arrives there once per task.
    """
    keys = df.groupBy(*[col(c) for c in data_columns(df)])  # unlike dropDuplicates, takes maps as well
    if ROW_ID not in df.columns:
        return keys.agg(F.count(F.lit(1)).alias("_copies")).select(*[col(c) for c in df.columns])
    kept = keys.agg(F.min(ROW_ID).alias(ROW_ID))
    return kept.select(*[col(c) for c in df.columns])


def dedupe_subset(df: DataFrame, subset: Sequence[str] | str = "all", order_by: str | None = None) -> DataFrame:
    """Keep the first row of each group of rows that agree on ``subset``.

    "First" is by ``order_by``, else ``_row_id``, else by the remaining columns. The rank
    test lets each task keep one row per key before the shuffle.
    """
    if isinstance(subset, str):
        if subset == "all":
            return dedupe_rows(df)
        subset = [subset]
    order = order_by or (ROW_ID if ROW_ID in df.columns else None)
    rest = [order] if order else [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates()
    first = Window.partitionBy(*[col(c) for c in subset]).orderBy(*[col(c) for c in rest])
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


# --- Imputation -------------------------------------------------------------
NUMERIC_STRATEGIES = ("median", "mean", "mode", "fixed", "zero", "none")
CATEGORICAL_STRATEGIES = ("mode", "unknown", "none", "fixed")


@dataclass(frozen=True)
class Imputation:
    """Fill values found on one table; ``apply`` works on any table with its columns."""

    fills: dict[str, object] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)
    rows: int = 0

    @property
    def total(self) -> int:
        return sum(self.filled.values())

    def missing_after(self) -> dict[str, int]:
        return {c: 0 if c in self.filled else n for c, n in self.missing.items()}

    def apply(self, df: DataFrame) -> DataFrame:
        return _replace(df, {c: _filled(df, c, v) for c, v in self.fills.items() if c in df.columns})

    def table(self, spark) -> DataFrame:
        """``column, missing_before, imputed, missing_after``."""
        after = self.missing_after()
        rows = [(c, n, self.filled.get(c, 0), after[c]) for c, n in self.missing.items()]
        return spark.createDataFrame(rows, "column string, missing_before bigint, imputed bigint, missing_after bigint")


def _filled(df: DataFrame, name: str, value):
    c = present(df, name)
    if isinstance(value, float) and integral_columns(df, [name]):
        c = c.cast("double")  # a fractional fill promotes a whole-number column
    elif isinstance(value, str) and boolean_columns(df, [name]):
        c = F.initcap(c.cast("string"))
    return F.coalesce(c, F.lit(value))


def fit_imputation(
    df: DataFrame,
    numeric: str = "median",
    categorical: str = "mode",
    fixed_numeric: float | None = None,
    fixed_categorical: str | None = None,
    columns: Sequence[str] | None = None,
) -> Imputation:
    """Find the fill value of every column that has missing cells.

    Numbers: median, mean, mode, fixed, zero or none. Text and booleans: mode (the
    smallest of the most frequent values, "Unknown" if there is none), unknown, fixed
    or none. Dates and nested columns are left alone.
    """
    if numeric not in NUMERIC_STRATEGIES:
        raise ValueError(f"Invalid numeric strategy: {numeric}. Allowed: {sorted(NUMERIC_STRATEGIES)}")
    if categorical not in CATEGORICAL_STRATEGIES:
        raise ValueError(f"Invalid categorical strategy: {categorical}. Allowed: {sorted(CATEGORICAL_STRATEGIES)}")
    if (numeric == "fixed" and fixed_numeric is None) or (categorical == "fixed" and fixed_categorical is None):
        raise ValueError("The fixed strategy needs a fill value")
    rows, missing = missing_counts(df, columns)
    gaps = [c for c, n in missing.items() if n]
    numbers = numeric_columns(df, gaps)
    texts = string_columns(df, gaps) + boolean_columns(df, gaps)

    fills: dict[str, object] = {}
    if numeric == "median":
        for batch in batches(numbers):
            fills.update({c: q[0] for c, q in exact_quantiles(df, batch, (0.5,)).items()} if batch else {})
    elif numeric == "mean":
        for batch in batches(numbers):
            if batch:
                fills.update(df.agg(*[F.avg(present(df, c)).cast("double").alias(c) for c in batch]).first().asDict())
    elif numeric == "mode":
        fills.update(modes(df, numbers))
    elif numeric == "zero":
        fills.update({c: 0 for c in numbers})
    elif numeric == "fixed":
        value = fixed_numeric
        fills.update({c: int(value) if float(value).is_integer() else float(value) for c in numbers})

    if categorical == "mode":
        common = modes(df, texts)
        fills.update({c: common.get(c, UNKNOWN) for c in texts})
        for c in boolean_columns(df, texts):  # counted as text
            fills[c] = {"true": True, "false": False}.get(fills[c], UNKNOWN)
    elif categorical == "unknown":
        fills.update({c: UNKNOWN for c in texts})
    elif categorical == "fixed":
        fills.update({c: fixed_categorical for c in texts})

    fills = {c: v for c, v in fills.items() if v is not None}
    return Imputation(fills, {c: missing[c] for c in fills}, missing, rows)


def impute(df: DataFrame, numeric: str = "median", categorical: str = "mode", **options) -> DataFrame:
    return fit_imputation(df, numeric, categorical, **options).apply(df)


__all__ = [
    "Imputation", "dedupe_rows", "dedupe_subset", "drop_empty_columns", "finite_only", "fit_imputation",
    "impute", "missing_profile", "normalise_missing", "nullify_blank", "sparse_columns", "trim_strings",
]
