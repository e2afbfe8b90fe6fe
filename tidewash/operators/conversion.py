"""Type conversion decided by the data, by a declared spec or by column rules.

``fit_conversions`` reads the table once and returns a plan; ``ConversionPlan.apply`` is
a plain projection. The plan can be kept and applied to other tables with the same
columns, streams included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, number_from_pattern, number_with_unit, parse_number, parse_timestamp, strip, to_number
from ..functions.dates import DATE_SHAPES, DateShape, maybe_timestamp
from ..functions.numbers import (
    UNIT_FACTORS,
    default_unit_pattern,
    parse_boolean,
    parse_whole_number,
    standard_units,
    unit_parts,
)
from .columns import FieldSpec, data_columns, datetime_columns, numeric_columns, string_columns
from .stats import batches, present

# Share of the non-null cells that must convert: numbers with a unit, then the others.
UNIT_SHARE = 0.3
CONVERT_SHARE = 0.5

CONVERSION_SCHEMA = (
    "column string, before_dtype string, after_dtype string, action string, reason string, "
    "converted_count bigint, unit string, pattern_used string"
)


@dataclass(frozen=True)
class Conversion:
    """What happens to one column. ``action`` names the expression ``apply`` builds."""

    column: str
    before: str
    after: str
    action: str
    reason: str | None = None
    converted: int = 0
    values: int = 0
    unit: str | None = None
    pattern: str | None = None
    fill: float | None = None

    def expression(self, shapes: Sequence[DateShape]) -> Column:
        c = col(self.column)
        if self.action == "unit_extraction":
            c = number_with_unit(c)
        elif self.action == "to_numeric":
            c = to_number(c)
        elif self.action == "to_datetime":
            c = parse_timestamp(self.column, shapes)
        elif self.action == "read_integer":
            c = parse_whole_number(c)
        elif self.action == "read_float":
            c = parse_number(c)
        elif self.action == "read_boolean":
            c = parse_boolean(c)
        elif self.action in ("schema_extraction", "rule_extraction"):
            c = number_from_pattern(c, self.pattern)
        elif self.action == "unit_standardisation":
            c = standard_units(c, self.unit, self.pattern)
        return c if self.fill is None else F.coalesce(c, F.lit(self.fill))


@dataclass(frozen=True)
class ConversionPlan:
    conversions: tuple[Conversion, ...]
    rows: int = 0
    shapes: tuple[DateShape, ...] = DATE_SHAPES

    def apply(self, df: DataFrame) -> DataFrame:
        changed = {c.column: c.expression(self.shapes) for c in self.conversions if c.before != c.after}
        return df.select(*[changed[n].alias(n) if n in changed else col(n) for n in df.columns])

    @property
    def converted_total(self) -> int:
        return sum(c.converted for c in self.conversions)

    def missing(self) -> dict[str, int]:
        """Null cells per column after the conversion."""
        return {c.column: 0 if c.fill is not None else self.rows - c.values for c in self.conversions}

    def table(self, spark) -> DataFrame:
        rows = [
            (c.column, c.before, c.after, c.action, c.reason, c.converted, c.unit, c.pattern)
            for c in self.conversions
        ]
        return spark.createDataFrame(rows, CONVERSION_SCHEMA)


def _declared(name: str, spec: FieldSpec, rules: Mapping[str, Mapping]) -> Conversion | None:
    """The conversion a spec or rule asks for on a text column, before it is counted."""
    f = spec.fields.get(name)
    if f is not None and f.unit_standardization and f.unit in UNIT_FACTORS:
        pattern = f.unit_pattern or default_unit_pattern(f.unit)
        return Conversion(name, "string", "double", "unit_standardisation", unit=f.unit, pattern=pattern)
    if f is not None and f.type == "numeric":
        return Conversion(name, "string", "double", "schema_extraction", unit=f.unit or "unknown", pattern=f.pattern)
    if not spec.fields and name in rules:
        rule = rules[name]
        return Conversion(name, "string", "double", "rule_extraction", unit=rule.get("unit", "unknown"), pattern=rule["regex"])
    return None


def _counters(
    name: str, stripped: str, declared: Conversion | None, read: bool, shapes: Sequence[DateShape]
) -> dict[str, Column]:
    """Aggregates over a text column and its ``stripped`` form; ``dated`` is no less than the number of dates."""
    c, s = col(name), F.col(stripped)
    counters = {"n": F.count(c)}
    if read:
        counters |= {
            "integer": F.count(parse_whole_number(s, stripped=True)),
            "float": F.count(parse_number(s, stripped=True)),
            "boolean": F.count(parse_boolean(c)),
        }
    if declared is not None:
        value = declared.expression(shapes)
        counters |= {"value": F.count(value), "mean": F.avg(value)}
        if declared.action == "unit_standardisation":
            _, unit = unit_parts(c, declared.pattern)
            counters["known"] = F.count_if(value.isNotNull() & unit.isin(*UNIT_FACTORS[declared.unit]))
        return counters
    return counters | {
        "unit": F.count(number_with_unit(s, stripped=True)),
        "number": F.count(to_number(s, stripped=True)),
        "dated": F.count_if(maybe_timestamp(stripped)),
    }


def _time_counter(stripped: str, shapes: Sequence[DateShape]) -> dict[str, Column]:
    """The aggregate of the dates, too long for Spark's compiler: only for columns that can turn out as such."""
    return {"time": F.count(parse_timestamp(stripped, shapes, stripped=True))}


def _with_stripped(df: DataFrame, batch: Sequence[str], texts: set[str]) -> DataFrame:
    """The batch's columns, and ``s<i>`` for each text column, stripped once for all tests."""
    return df.select(*[col(c) for c in batch], *[strip(col(c)).alias(f"s{i}") for i, c in enumerate(batch) if c in texts])


def _counted(df: DataFrame, batch: Sequence[str], texts: set[str], counts: Mapping[str, Mapping[str, Column]]) -> tuple[int, dict[str, dict]]:
    """Number of rows, and what the aggregates of each column give; one pass over the batch's columns."""
    flat = [a.alias(f"{i}:{k}") for i, counters in enumerate(counts.values()) for k, a in counters.items()]
    row = _with_stripped(df, batch, texts).agg(F.count(F.lit(1)).alias("rows"), *flat).first()
    return row["rows"], {c: {k: row[f"{i}:{k}"] for k in counters} for i, (c, counters) in enumerate(counts.items())}


def _reader_type(name: str, got: dict[str, int]) -> Conversion | None:
    """The type all cells have, if the reader's types were counted."""
    n = got["n"]
    for kind, action, dtype in (
        ("integer", "read_integer", "bigint"),
        ("float", "read_float", "double"),
        ("boolean", "read_boolean", "boolean"),
    ):
        if n and got.get(kind) == n:
            return Conversion(name, "string", dtype, action, "reader_type", values=n)
    return None


def _least(n: int, share: float) -> int:
    return max(1, int(share * n))


def _open_to_dates(got: Mapping[str, int], protect_dates: bool) -> bool:
    """Whether a column's dates decide what it becomes."""
    n = got["n"]
    earlier = not protect_dates and (got["unit"] >= _least(n, UNIT_SHARE) or got["number"] >= _least(n, CONVERT_SHARE))
    return n > 0 and not earlier and got["dated"] >= _least(n, CONVERT_SHARE)


def _ladder(name: str, got: dict[str, int], protect_dates: bool) -> Conversion:
    n = got["n"]
    if n == 0:
        return Conversion(name, "string", "string", "none", "empty")
    rungs = [
        ("unit", "unit_extraction", "double", UNIT_SHARE),
        ("number", "to_numeric", "double", CONVERT_SHARE),
        ("time", "to_datetime", "timestamp_ntz", CONVERT_SHARE),
    ]
    if protect_dates:
        rungs.insert(0, rungs.pop())
    for kind, action, dtype, share in rungs:
        if got[kind] >= _least(n, share):
            return Conversion(name, "string", dtype, action, converted=got[kind], values=got[kind])
    return Conversion(name, "string", "string", "none", "no_conversion_rule_matched", values=n)


def fit_conversions(
    df: DataFrame,
    spec: FieldSpec | Mapping | None = None,
    rules: Mapping[str, Mapping] | None = None,
    convert: bool = True,
    fill_after_extract: bool = True,
    read_types: bool = False,
    protect_dates: bool = False,
    shapes: Sequence[DateShape] = DATE_SHAPES,
) -> ConversionPlan:
    """Decide the conversion of every column from one pass of counters, and a second over the columns whose
    dates decide, if there are any.

    A text column becomes numbers if enough cells are numbers with a unit word, else if
    half are numbers after deleting commas and blanks, else timestamps if half are dates;
    cells that fail become null. Fields a spec declares numeric (or columns with a rule,
    without a spec) are extracted with their pattern instead, and gaps filled with the
    mean if ``fill_after_extract``. ``read_types`` first gives every column
    (declared ones too) the whole-number, decimal or boolean type all its cells have, as a
    CSV reader does. ``protect_dates`` tries
    dates before units, which otherwise take "5 January 2024" for 5.
    """
    spec, rules = FieldSpec.parse(spec), rules or {}
    texts = set(string_columns(df)) if convert else set()
    numbers, dates, dtypes = set(numeric_columns(df)), set(datetime_columns(df)), dict(df.dtypes)
    done: list[Conversion] = []
    rows = 0
    for batch in batches(data_columns(df)):
        declared = {c: _declared(c, spec, rules) for c in batch if c in texts}
        counts = {
            c: _counters(c, f"s{i}", declared[c], read_types, shapes)
            if c in texts
            else {"n": F.count(present(df, c))}
            for i, c in enumerate(batch)
        }
        rows, found = _counted(df, batch, texts, counts)
        dated = [c for c in batch if "dated" in found[c] and _reader_type(c, found[c]) is None and _open_to_dates(found[c], protect_dates)]
        if dated:
            more = _counted(df, dated, texts, {c: _time_counter(f"s{i}", shapes) for i, c in enumerate(dated)})[1]
            found = {c: found[c] | more.get(c, {}) for c in found}
        for c in batch:
            got = {"time": 0, **found[c]}
            read = _reader_type(c, got) if c in texts else None
            if read is not None:
                done.append(read)
            elif c in texts and declared[c] is not None:
                d = declared[c]
                fill = got["mean"] if fill_after_extract and got["value"] and got["value"] < rows else None
                count = got.get("known", got["value"])
                done.append(Conversion(c, d.before, d.after, d.action, None, count, got["value"], d.unit, d.pattern, fill))
            elif c in texts:
                done.append(_ladder(c, got, protect_dates))
            elif not convert:
                done.append(Conversion(c, dtypes[c], dtypes[c], "skipped", "convert_types_disabled", values=got["n"]))
            else:
                reason = "already_numeric" if c in numbers or dtypes[c] == "boolean" else "already_datetime" if c in dates else "no_conversion_rule_matched"
                done.append(Conversion(c, dtypes[c], dtypes[c], "none", "empty" if not got["n"] else reason, values=got["n"]))
    return ConversionPlan(tuple(done), rows, tuple(shapes))


def convert_types(df: DataFrame, **options) -> DataFrame:
    return fit_conversions(df, **options).apply(df)


def apply_spec(df: DataFrame, spec: FieldSpec | Mapping, fill_after_extract: bool = True) -> tuple[DataFrame, ConversionPlan]:
    """Only the conversions a spec declares; other columns stay as they are."""
    spec = FieldSpec.parse(spec)
    names = [c for c in string_columns(df) if _declared(c, spec, {})]
    plan = fit_conversions(df.select(*[col(c) for c in names]), spec, fill_after_extract=fill_after_extract)
    return plan.apply(df), plan


def apply_rules(df: DataFrame, rules: Mapping[str, Mapping], fill_after_extract: bool = True) -> tuple[DataFrame, ConversionPlan]:
    """Only the columns with a rule ``{"regex": …, "unit": …}``."""
    names = [c for c in string_columns(df) if c in rules]
    plan = fit_conversions(df.select(*[col(c) for c in names]), rules=rules, fill_after_extract=fill_after_extract)
    return plan.apply(df), plan


def ladder_counts(df: DataFrame, shapes: Sequence[DateShape] = DATE_SHAPES) -> DataFrame:
    """The evidence of the ladder, one row per text column, without deciding anything."""
    names = string_columns(df)
    kinds = ("n", "unit", "number", "time")
    flat = [
        (_counters(c, f"s{i}", None, False, shapes) | _time_counter(f"s{i}", shapes))[k].alias(f"{i}_{k}") for i, c in enumerate(names) for k in kinds
    ]
    labels = ("non_null", "unit_count", "number_count", "datetime_count")
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(label) for k, label in zip(kinds, labels)])
        for i, c in enumerate(names)
    ]
    return _with_stripped(df, names, set(names)).agg(*flat).select(F.inline(F.array(*entries)))
