"""A run given as an ordered list of steps, each with its own options."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import boolean_columns, data_columns, numeric_columns, string_columns
from ..operators.conversion import ConversionPlan, fit_conversions
from ..operators.missing import CATEGORICAL_STRATEGIES, NUMERIC_STRATEGIES, Imputation, dedupe_subset, fit_imputation, normalise_missing, sparse_columns, trim_strings
from ..operators.outliers import any_outlier, outlier_limits
from ..sources.tables import stage_table
from .lineage import Event
from .rules import flag, one_of, option
from .run import SAMPLE_ROWS, CleaningResult, Counts, closing, column_samples

NUMERIC_ONLY = tuple(s for s in NUMERIC_STRATEGIES if s not in CATEGORICAL_STRATEGIES)
CATEGORICAL_ONLY = tuple(s for s in CATEGORICAL_STRATEGIES if s not in NUMERIC_STRATEGIES)


@dataclass
class Progress:
    """The table so far and what the steps found."""

    df: DataFrame
    counts: Counts
    conversions: ConversionPlan
    imputation: Imputation = field(default_factory=Imputation)
    events: list[Event] = field(default_factory=list)
    stage: bool = True

    def rows(self) -> int:
        return self.df.count()


def columns_of(df: DataFrame, which) -> list[str] | None:
    """``all`` (None), ``numeric``, ``categorical``, a name or a list of names."""
    groups = {"all": lambda: None, "numeric": lambda: numeric_columns(df), "categorical": lambda: string_columns(df) + boolean_columns(df)}
    if isinstance(which, str):
        return groups.get(which, lambda: [which])()
    return list(which)


def selection(value) -> str | list[str]:
    if isinstance(value, str):
        return value
    if isinstance(value, Sequence) and all(isinstance(v, str) for v in value):
        return list(value)
    raise ValueError(f"{value!r} names no columns")


# Names of the steps, their options and the defaults are fixed values.
@dataclass(frozen=True)
class TrimWhitespace:
    name: ClassVar[str] = "trim_whitespace"
    apply_to: str | list[str] = option("all", selection)

    def run(self, p: Progress) -> None:
        p.df = trim_strings(p.df, columns_of(p.df, self.apply_to))


@dataclass(frozen=True)
class TypeInference:
    name: ClassVar[str] = "type_inference"
    enabled: bool = option(True, flag)

    def run(self, p: Progress) -> None:
        if self.enabled:
            p.conversions = fit_conversions(p.df)
            p.df = p.conversions.apply(p.df)
            p.events.append(Event("types_converted", "columns retyped by their values", p.conversions.converted_total))


@dataclass(frozen=True)
class DropEmptyColumns:
    name: ClassVar[str] = "drop_empty_columns"
    threshold: float = option(0.9, float)

    def run(self, p: Progress) -> None:
        gone = sparse_columns(p.df, self.threshold)
        p.df = p.df.drop(*gone)
        p.counts.dropped += gone
        p.events.append(Event("columns_dropped", f"at least {self.threshold:g} of the cells missing", len(gone), details={"columns": gone}))


@dataclass(frozen=True)
class Deduplicate:
    name: ClassVar[str] = "deduplicate"
    subset: str | list[str] = option("all", selection)

    def run(self, p: Progress) -> None:
        before = p.rows()
        p.df = dedupe_subset(p.df, self.subset)
        p.df = stage_table(p.df) if p.stage else p.df
        gone = before - p.rows()
        p.counts.duplicates += gone
        p.events.append(Event("rows_dropped", "copies of an earlier row", gone, details={"subset": self.subset}))


@dataclass(frozen=True)
class Impute:
    name: ClassVar[str] = "impute"
    strategy: str = option("median", one_of(*NUMERIC_STRATEGIES, *CATEGORICAL_ONLY))
    apply_to: str | list[str] = option("numeric", selection)
    value: object = option(None, lambda v: v)

    def __post_init__(self) -> None:
        if self.strategy == "fixed" and self.value is None:
            raise ValueError("a fixed filling needs a value")

    def run(self, p: Progress) -> None:
        targets = columns_of(p.df, self.apply_to)
        if targets == []:
            return
        # A strategy for one kind of column leaves numbers as they are, or fills text with its mode.
        numeric = self.strategy if self.strategy in NUMERIC_STRATEGIES and numeric_columns(p.df, targets) else "none"
        categorical = "mode" if self.strategy in NUMERIC_ONLY else self.strategy
        number = float(self.value) if numeric == "fixed" else None
        found = fit_imputation(p.df, numeric, categorical, number, None if self.value is None else str(self.value), columns=targets)
        p.df, filled = found.apply(p.df), {**p.imputation.filled}
        for c, n in found.filled.items():
            filled[c] = filled.get(c, 0) + n
        p.imputation = replace(found, fills={**p.imputation.fills, **found.fills}, filled=filled, missing={**found.missing, **p.imputation.missing})
        p.events.append(Event("nulls_imputed", f"gaps filled by {self.strategy}", found.total, details=found.filled))


@dataclass(frozen=True)
class RemoveOutliers:
    name: ClassVar[str] = "remove_outliers"
    method: str = option("iqr", one_of("iqr"))
    threshold: float = option(1.5, float)
    columns: list[str] | None = option(None, lambda v: None if v is None else [v] if isinstance(v, str) else selection(v))

    def run(self, p: Progress) -> None:
        test = any_outlier(p.df, outlier_limits(p.df, self.columns, self.threshold))
        gone = p.df.agg(F.count_if(test)).first()[0]
        p.df = p.df.filter(~F.coalesce(test, F.lit(False)))
        p.counts.outliers += gone
        p.events.append(Event("outliers_removed", f"outside {self.threshold:g} interquartile ranges", gone))


STEPS: dict[str, type] = {kind.name: kind for kind in (Impute, Deduplicate, TrimWhitespace, RemoveOutliers, TypeInference, DropEmptyColumns)}


def parse_step(given: Mapping) -> object:
    """A typed step from ``{"step": name, option: value, ...}``."""
    if not isinstance(given, Mapping) or given.get("step") not in STEPS:
        raise ValueError(f"{given!r} is no step; steps are {', '.join(sorted(STEPS))}")
    kind = STEPS[given["step"]]
    checks: dict[str, Callable] = {f.name: f.metadata["check"] for f in fields(kind)}
    options = {}
    for name, value in given.items():
        if name == "step":
            continue
        if name not in checks:
            raise ValueError(f"Step {kind.name} has no option {name}")
        try:
            options[name] = checks[name](value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"Option {name} of step {kind.name}: {e}") from e
    try:
        return kind(**options)
    except ValueError as e:
        raise ValueError(f"Step {kind.name}: {e}") from e


def parse_steps(config: Mapping | Sequence) -> list:
    """Typed steps of a list, or of ``{"pipeline": {"steps": [...]}}``."""
    if isinstance(config, Mapping):
        inner = config.get("pipeline")
        config = inner.get("steps") if isinstance(inner, Mapping) else None
    if not isinstance(config, (list, tuple)):
        raise ValueError("Steps come as a list, or as one under pipeline and steps")
    return [parse_step(s) for s in config]


def run_steps(df: DataFrame, config: Mapping | Sequence, profile: bool = False, stage: bool = True) -> CleaningResult:
    """Missing tokens become null, then the steps run in the listed order.

    Steps that need statistics read the table as the steps before left it; after each
    deduplication it is written to the shared folder (``stage``), so those reads do not
    shuffle it again.
    """
    steps, given = parse_steps(config), data_columns(df)
    samples = {"before": column_samples(df, SAMPLE_ROWS)}
    df = normalise_missing(df)
    untouched = fit_conversions(df, convert=False)
    p = Progress(df, Counts(untouched.rows, untouched.missing()), untouched, stage=stage)
    p.events.append(Event("file_loaded", "table given to the steps", untouched.rows, details={"columns": given}))
    for step in steps:
        step.run(p)
    return closing(p.df, p.counts, given, p.conversions, p.imputation, p.events, samples, profile=profile, config=[s.name for s in steps])


def apply_steps(df: DataFrame, config: Mapping | Sequence, stage: bool = True) -> DataFrame:
    """The table that :func:`run_steps` makes, without the report."""
    steps = parse_steps(config)
    p = Progress(normalise_missing(df), Counts(0, {}), ConversionPlan(()), stage=stage)
    for step in steps:
        step.run(p)
    return p.df
