"""Column names and classes: mapping to a declared spec, duplicate names, selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ROW_ID
from ..functions import col


# --- Declared fields --------------------------------------------------------
@dataclass(frozen=True)
class Field:
    """One declared column."""

    name: str
    aliases: tuple[str, ...] = ()
    type: str | None = None
    unit: str | None = None
    pattern: str | None = None
    unit_standardization: bool = False
    unit_pattern: str | None = None
    required: bool = False
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class FieldSpec:
    """The declared columns of a table, and the look-ups from incoming names."""

    fields: Mapping[str, Field] = field(default_factory=dict)

    @staticmethod
    def parse(spec: Mapping | FieldSpec | None) -> FieldSpec:
        """Accept ``{"fields": {...}}``, the same under ``"schema"``, or nothing."""
        if isinstance(spec, FieldSpec):
            return spec
        body = spec or {}
        body = body.get("schema") or body
        known = set(Field.__dataclass_fields__) - {"name"}
        fields = {}
        for name, given in (body.get("fields") or {}).items():
            options = {k: v for k, v in given.items() if k in known and v is not None}
            options["aliases"] = tuple(options.get("aliases", ()))
            fields[name] = Field(name=name, **options)
        return FieldSpec(fields)

    def resolve(self, name: str) -> tuple[str, str]:
        """(canonical name, how it matched) for one incoming column name.

        A canonical name wins over an alias, an alias over a match that ignores case;
        among equal claims the field declared last wins.
        """
        if name in self.fields:
            return name, "exact"
        claims = [(f.name, (f.name, *f.aliases)) for f in reversed(list(self.fields.values()))]
        for canonical, names in claims:
            if name in names:
                return canonical, "alias"
        for canonical, names in claims:
            if name.lower() in {n.lower() for n in names}:
                return canonical, "case_insensitive"
        return name, "unmapped"


def mapping_report(df: DataFrame, spec: FieldSpec | Mapping) -> DataFrame:
    """One row per column: ``original, mapped_to, match_type``."""
    spec = FieldSpec.parse(spec)
    rows = [(name, *spec.resolve(name)) for name in data_columns(df)]
    return df.sparkSession.createDataFrame(rows, "original string, mapped_to string, match_type string")


def apply_mapping(df: DataFrame, spec: FieldSpec | Mapping, check_empty: bool = False) -> DataFrame:
    """Rename columns to their canonical names; row data is untouched.

    Two columns may resolve to one name: run ``resolve_duplicates`` next. With
    ``check_empty`` a table without rows is returned unchanged (costs a small job).
    """
    if check_empty and df.isEmpty():
        return df
    spec = FieldSpec.parse(spec)
    return df.toDF(*[n if n == ROW_ID else spec.resolve(n)[0] for n in df.columns])


# --- Duplicate names --------------------------------------------------------
@dataclass(frozen=True)
class Rename:
    position: int
    before: str
    after: str


def unique_names(names: Sequence[str | None]) -> tuple[list[str], list[Rename]]:
    """Give repeats of a name the suffixes ``_1``, ``_2``, … skipping taken names."""
    given = [n or "" for n in names]
    taken = set(given)
    repeats: dict[str, int] = {}
    result: list[str] = []
    renames: list[Rename] = []
    for position, name in enumerate(given):
        after = name
        if name in repeats:
            while after in taken:
                repeats[name] += 1
                after = f"{name}_{repeats[name]}"
            taken.add(after)
            renames.append(Rename(position, name, after))
        else:
            repeats[name] = 0
        result.append(after)
    return result, renames


def resolve_duplicates(df: DataFrame) -> DataFrame:
    """Rename repeated column names so that each can be referenced."""
    return df.toDF(*unique_names(df.columns)[0])


# --- Selection by class -----------------------------------------------------
def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def _of_types(df: DataFrame, types: tuple, columns: Iterable[str] | None) -> list[str]:
    wanted = None if columns is None else set(columns)
    return [
        f.name
        for f in df.schema.fields
        if f.name != ROW_ID and isinstance(f.dataType, types) and (wanted is None or f.name in wanted)
    ]


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.NumericType,), columns)


def integral_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.IntegralType,), columns)


def floating_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.FloatType, T.DoubleType), columns)


def string_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.StringType,), columns)


def boolean_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.BooleanType,), columns)


def datetime_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.TimestampType, T.TimestampNTZType, T.DateType), columns)


def nested_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    return _of_types(df, (T.ArrayType, T.MapType, T.StructType), columns)


def head_rows(df: DataFrame, n: int, order_by: str | None = None) -> DataFrame:
    """First ``n`` rows in ``order_by`` order: each task keeps ``n``, then they merge."""
    if order_by is None and ROW_ID in df.columns:
        order_by = ROW_ID
    if order_by is None:
        return df.limit(n)
    return df.orderBy(col(order_by)).limit(n)


def first_rows(df: DataFrame, n: int, order_by: str | None = None) -> list[Row]:
    """``head_rows`` on the driver, for a few rows of a large table.

    Finds the place of the n-th row from the ordering column alone; the filter on it then
    skips nearly all of a columnar table while the whole rows are read.
    """
    if order_by is None and ROW_ID in df.columns:
        order_by = ROW_ID
    if order_by is None:
        return df.limit(n).collect()
    key = col(order_by)
    places = df.select(key.alias("place")).orderBy("place").limit(n).collect()
    if places and places[-1]["place"] is not None and order_by in integral_columns(df):
        df = df.filter(key.isNull() | (key <= F.lit(places[-1]["place"])))
    return df.orderBy(key).limit(n).collect()


def column_samples(df: DataFrame, n: int, order_by: str | None = None) -> dict[str, list]:
    """The first ``n`` values of every column."""
    rows = first_rows(df, n, order_by)
    return {c: [r[c] for r in rows] for c in data_columns(df)}


# --- Row numbers ------------------------------------------------------------
# Rows that one part of ``dense_row_id`` numbers.
ROW_ID_PART_BITS = 20


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``_row_id``, increasing in scan order. Use directly on a file scan."""
    return df.select(F.monotonically_increasing_id().alias(ROW_ID), *[col(c) for c in df.columns])


def with_file_row_id(df: DataFrame) -> DataFrame:
    """Add ``_row_id`` to a scan of Parquet files: 0, 1, 2, … through the files in the order of their paths,
    whatever the number of tasks. Rows are counted per file, and files number their own rows."""
    place = df.metadataColumn("_metadata")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.select(place["file_path"].alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = df.select(*[col(c) for c in df.columns], place["file_path"].alias("_file"), place["row_index"].alias("_place"))
    return placed.join(starts, "_file").select((F.col("_start") + F.col("_place")).alias(ROW_ID), *[col(c) for c in df.columns])


def dense_row_id(df: DataFrame) -> DataFrame:
    """Replace ``_row_id`` with 0, 1, 2, … in the same order, also after rows have gone.

    Rows are counted per part of the numbers' range, so each part is numbered by itself and starts
    after those before it; the running total is over one row per part.
    """
    tagged = df.withColumn("_part", F.shiftright(F.col(ROW_ID), ROW_ID_PART_BITS))
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(ROW_ID)) - 1
    joined = tagged.join(offsets, "_part").withColumn(ROW_ID, F.col("_offset") + place)
    return joined.select(ROW_ID, *[col(c) for c in data_columns(df)])
