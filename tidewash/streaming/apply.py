"""Cleaning of a stream with what was found on an earlier table.

Conversions, fill values and outlier bounds need a whole table to find but only a
projection and a filter to apply, so a kept result serves arriving rows unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import FieldSpec, apply_mapping, unique_names
from ..operators.conversion import ConversionPlan
from ..operators.missing import Imputation, normalise_missing
from ..operators.outliers import Limits, any_outlier


def clean_stream(
    stream: DataFrame, conversions: ConversionPlan, imputation: Imputation | None = None, limits: Limits | None = None,
    spec: FieldSpec | Mapping | None = None, dropped: Sequence[str] = (), trim: bool = True,
) -> DataFrame:
    """Names mapped by ``spec``, tokens to null, kept conversions, columns dropped, kept fill values,
    kept outlier bounds: what the run did, in its order."""
    df = stream if spec is None else apply_mapping(stream, spec)
    df = df.toDF(*unique_names(df.columns)[0])
    df = conversions.apply(normalise_missing(df, trim=trim)).drop(*dropped)
    if imputation is not None:
        df = imputation.apply(df)
    return df if limits is None else df.filter(~F.coalesce(any_outlier(df, limits), F.lit(False)))
