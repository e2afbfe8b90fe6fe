"""The whole run: map names, convert types, clean, drop outliers, validate, profile."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ROW_ID
from ..operators.columns import FieldSpec, apply_mapping, column_samples, data_columns, mapping_report, numeric_columns, unique_names
from ..operators.conversion import ConversionPlan, fit_conversions
from ..operators.missing import Imputation, dedupe_rows, fit_imputation, normalise_missing
from ..operators.outliers import any_outlier, outlier_limits
from ..operators.profile import profile_table
from ..operators.semantic import infer_semantic_types
from ..operators.validate import ISSUE_SCHEMA, ValidationError, find_issues
from ..sinks import json_safe, spreadsheet_safe, write_csv, write_json, write_parquet
from ..sources.csv import read_csv
from ..sources.tables import stage_table
from .lineage import Event, lineage_table
from .rules import CleaningRules

SAMPLE_ROWS = 10
PREVIEW_ROWS = 5
NO_ROWS, NO_COLUMNS = "no rows are left of the table", "no columns are left of the table"

SUMMARY_SCHEMA = (
    "rows_before bigint, rows_after bigint, columns_before bigint, columns_after bigint, duplicates_removed bigint, "
    "outliers_removed bigint, columns_dropped array<string>, missing_filled_total bigint, "
    "missing_filled_per_column map<string,bigint>, missing_before map<string,bigint>, missing_after map<string,bigint>, "
    "converted_total bigint, columns_renamed map<string,string>, encoding string, config_used string"
)


@dataclass
class Counts:
    """What a run counted on its way."""

    rows: int
    missing: dict[str, int]
    duplicates: int = 0
    outliers: int = 0
    dropped: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CleaningResult:
    """The cleaned table (unevaluated) and what was found on the way (small)."""

    df: DataFrame
    conversions: ConversionPlan
    imputation: Imputation
    events: list[Event]
    summary: DataFrame
    mapping: DataFrame | None
    issues: DataFrame
    semantic_types: dict[str, str] | None
    profile: DataFrame | None
    samples: dict[str, dict[str, list]]
    renames: dict[str, str] = field(default_factory=dict)

    @property
    def lineage(self) -> DataFrame:
        return lineage_table(self.df.sparkSession, self.events)

    def report(self) -> DataFrame:
        """The run in one row: the summary plus every small table as an array."""
        spark = self.df.sparkSession
        tables = {
            "type_conversions": self.conversions.table(spark), "field_mapping": self.mapping, "schema_validation": self.issues,
            "profile": self.profile, "lineage": self.lineage,
        }
        tables = {name: t for name, t in tables.items() if t is not None}
        kinds = [*self.summary.schema.fields, *[T.StructField(name, T.ArrayType(t.schema)) for name, t in tables.items()]]
        row = (*self.summary.first(), *[[tuple(r) for r in t.collect()] for t in tables.values()])
        report = spark.createDataFrame([row], T.StructType(kinds)).withColumns(
            {
                "semantic_types": F.from_json(F.lit(json.dumps(self.semantic_types or {})), "map<string,string>"),
                "samples": F.lit(_sample_text(self.samples)),
            }
        )
        return json_safe(report)

    def release(self) -> None:
        """Delete the staged table behind ``df``, once its rows are no longer needed."""
        spark = self.df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in self.df.inputFiles() if "/tidewash-" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sample_text(samples: dict[str, dict[str, list]]) -> str:
    """Sample values as JSON; what JSON cannot hold as text, NaN and infinities as null."""
    def cell(v):
        return None if isinstance(v, float) and not math.isfinite(v) else v

    values = {when: {c: [cell(v) for v in vs] for c, vs in columns.items()} for when, columns in samples.items()}
    return json.dumps(values, ensure_ascii=False, default=str)


def clean_table(
    df: DataFrame,
    rules: CleaningRules | Mapping | None = None,
    spec: FieldSpec | Mapping | None = None,
    profile: bool = True,
    stage: bool = True,
    read_types: bool = False,
    source: str = "Table",
    encoding: str | None = None,
) -> CleaningResult:
    """Clean ``df`` and report on it.

    One pass over the input counts everything that conversion and column dropping
    depend on. The deduplicated table is then written once to the shared folder
    (``stage``), and the remaining statistics read single columns of it. The table
    returned adds only projections and filters to that.
    """
    spark = df.sparkSession
    rules, events = CleaningRules.of(rules, spark), []
    given = data_columns(df)
    # Rows come in scan order here, so the first task alone delivers them.
    samples = {"before": column_samples(df.drop(ROW_ID), SAMPLE_ROWS)}

    mapping, renames = None, []
    if spec is not None:
        spec = FieldSpec.parse(spec)
        mapping = mapping_report(df, spec)
        df = apply_mapping(df, spec)
    names, renames = unique_names(df.columns)
    df = df.toDF(*names)

    df = normalise_missing(df, trim=rules.trim_strings)
    conversions = fit_conversions(
        df, spec, convert=rules.convert_types, fill_after_extract=False, read_types=read_types and rules.convert_types
    )
    rows_before, missing_before = conversions.rows, conversions.missing()
    events.append(Event("file_loaded", f"read from: {source}", rows_before, details={"columns": given}))
    if rows_before == 0:
        raise ValidationError(NO_ROWS)
    events.append(Event("types_converted", "columns retyped by their values", conversions.converted_total, details={c.column: c.action for c in conversions.conversions}))
    df = conversions.apply(df)

    empty = [c for c, n in missing_before.items() if n == rows_before]
    dropped = empty if rules.drop_empty_columns else []
    df = df.drop(*dropped)
    events.append(Event("columns_dropped", "no cell had a value", len(dropped), details={"columns": dropped}))
    if not data_columns(df):
        raise ValidationError(NO_COLUMNS)

    if rules.drop_duplicates:
        df = dedupe_rows(df)
    if stage:
        df = stage_table(df)

    imputation = fit_imputation(
        df, rules.fill_missing_numeric, rules.fill_missing_categorical,
        rules.fill_value_numeric, rules.fill_value_categorical,
    )
    duplicates = rows_before - imputation.rows
    events.append(Event("rows_dropped", "copies of an earlier row", duplicates, details={"enabled": rules.drop_duplicates}))
    df = imputation.apply(df)
    strategy = f"numbers by {rules.fill_missing_numeric}, texts by {rules.fill_missing_categorical}"
    events.append(Event("nulls_imputed", f"gaps filled: {strategy}", imputation.total, details=imputation.filled))

    outliers = 0
    if rules.remove_outliers:
        limits = outlier_limits(df, k=rules.outlier_threshold)
        test = any_outlier(df, limits)
        outliers = df.agg(F.count_if(test)).first()[0]
        df = df.filter(~F.coalesce(test, F.lit(False)))
    reason = f"outside {rules.outlier_threshold:g} interquartile ranges" if rules.remove_outliers else "not asked for"
    events.append(Event("outliers_removed", reason, outliers, details={"columns": numeric_columns(df) if rules.remove_outliers else []}))
    events.append(Event("columns_renamed", "names used twice", len(renames), details={r.before: r.after for r in renames}))

    counts = Counts(rows_before, missing_before, duplicates, outliers, dropped)
    return closing(
        df, counts, given, conversions, imputation, events, samples, profile, rules.as_dict(), spec, mapping, encoding,
        {r.before: r.after for r in renames}, [c for c in empty if c not in dropped],
    )


def closing(
    df: DataFrame, counts: Counts, given: list[str], conversions: ConversionPlan, imputation: Imputation, events: list[Event], samples: dict,
    profile: bool, config, spec=None, mapping: DataFrame | None = None, encoding: str | None = None, renames: dict[str, str] | None = None, empty=(),
) -> CleaningResult:
    """Check the finished table, profile it and put the report together."""
    spark, rows, renames = df.sparkSession, counts.rows - counts.duplicates - counts.outliers, renames or {}
    if unnamed := [i for i, name in enumerate(df.columns) if not name.strip()]:
        raise ValidationError(f"Columns without a name at {unnamed}")
    if not data_columns(df):
        raise ValidationError(NO_COLUMNS)
    if rows <= 0:
        raise ValidationError(NO_ROWS)
    issues = find_issues(df, spec) + [(c, "column has no values") for c in empty]
    semantic = infer_semantic_types(df) if profile else None
    table = profile_table(df, semantic_types=semantic) if profile else None
    samples["after"] = column_samples(df, SAMPLE_ROWS)
    after = {c: n for c, n in {**counts.missing, **imputation.missing_after()}.items() if c in data_columns(df)}
    summary = spark.createDataFrame(
        [
            (
                counts.rows, rows, len(given), len(data_columns(df)), counts.duplicates, counts.outliers, counts.dropped,
                imputation.total, imputation.filled, counts.missing, after, conversions.converted_total, renames, encoding, json.dumps(config),
            )
        ],
        SUMMARY_SCHEMA,
    )
    return CleaningResult(
        df, conversions, imputation, events, summary, mapping, spark.createDataFrame(issues, ISSUE_SCHEMA), semantic, table, samples, renames,
    )


def clean_csv(spark: SparkSession, path: str, rules=None, spec=None, encodings=None, multi_line=None, **options) -> CleaningResult:
    """``clean_table`` on CSV files."""
    table = read_csv(spark, path, encodings=encodings, multi_line=multi_line)
    return clean_table(table.df, rules, spec, read_types=True, source="CSV file", encoding=table.encoding, **options)


def preview(result: CleaningResult, rows: int = PREVIEW_ROWS) -> dict[str, dict[str, list]]:
    """First values of each column before and after."""
    after = result.samples["after"]
    return {
        c: {"before": values[:rows], "after": after.get(c, [])[:rows]} for c, values in result.samples["before"].items()
    }


def write_outputs(result: CleaningResult, folder: str) -> dict[str, str]:
    """CSV, Parquet, spreadsheet-safe CSV, report and lineage under ``folder``.

    The cleaned rows are computed once: the other outputs read the Parquet copy.
    """
    spark = result.df.sparkSession
    paths = {k: f"{folder.rstrip('/')}/{k}" for k in ("parquet", "csv", "spreadsheet", "report", "lineage")}
    write_parquet(result.df, paths["parquet"])
    cleaned = spark.read.parquet(paths["parquet"])
    write_csv(cleaned, paths["csv"])
    write_csv(spreadsheet_safe(cleaned), paths["spreadsheet"])
    write_json(result.report(), paths["report"])
    write_json(result.lineage, paths["lineage"])
    return paths
