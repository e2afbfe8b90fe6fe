"""Outputs: CSV, Parquet, JSON lines, and the projection that fits spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ROW_ID
from ..functions import col, finite_or_null, spreadsheet_text
from ..functions.text import SPREADSHEET_CELL_LENGTH, exceeds_cell

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _without_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 with a header and doubled quotes; nulls are empty cells."""
    flat = _without_row_id(df)
    nested = [f.name for f in flat.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    flat = flat.select(*[F.to_json(col(c)).alias(c) if c in nested else col(c) for c in flat.columns])
    flat.write.mode(mode).options(header=True, encoding="UTF-8", quote='"', escape='"', emptyValue="").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _without_row_id(df).write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; NaN and infinities as null, timestamps in ISO form."""
    iso_timestamps(json_safe(df)).write.mode(mode).option("ignoreNullFields", False).json(path)


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite_or_null(c)
    if isinstance(kind, T.ArrayType) and _holds_floats(kind):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType) and _holds_floats(kind.valueType):
        return F.transform_values(c, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType) and _holds_floats(kind):
        fields = [_finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def json_safe(df: DataFrame) -> DataFrame:
    """Null for every non-finite number, inside nested columns too (``to_json`` would
    write them as the strings "NaN" and "Infinity")."""
    return df.select(*[_finite(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def iso_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text with microseconds."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    return df.select(*[F.date_format(col(c), ISO).alias(c) if c in times else col(c) for c in df.columns])


def _cell_text(c: Column, kind: T.DataType) -> Column | None:
    """The text that a spreadsheet cell gets, before it is made safe; None for what is no text there."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_finite(c, kind), {"ignoreNullFields": "false"})
    if isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return None
    return c.cast("string")


def spreadsheet_safe(df: DataFrame, length: int = SPREADSHEET_CELL_LENGTH) -> DataFrame:
    """Values a spreadsheet cell can hold.

    Text without control characters and at most ``length`` long (see :func:`cut_cells`); no NaN or
    infinity; zoned timestamps as wall clock; nested values as JSON text; numbers and booleans as
    they are.
    """
    safe = []
    for f in df.schema.fields:
        c, kind = col(f.name), f.dataType
        text = _cell_text(c, kind)
        if isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            c = finite_or_null(c)
        elif text is not None:
            c = spreadsheet_text(text, length)
        safe.append(c.alias(f.name))
    return df.select(*safe)


def cut_cells(df: DataFrame, length: int = SPREADSHEET_CELL_LENGTH) -> DataFrame:
    """``column, cut_count``: cells of each text or nested column that ``spreadsheet_safe`` cuts."""
    texts = {f.name: t for f in df.schema.fields if (t := _cell_text(col(f.name), f.dataType)) is not None}
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, cut_count bigint")
    counts = df.agg(*[F.count_if(exceeds_cell(t, length)).alias(f"c{i}") for i, t in enumerate(texts.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("cut_count")) for i, c in enumerate(texts)])))
