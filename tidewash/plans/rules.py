"""Options of a cleaning run."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from ..operators.missing import CATEGORICAL_STRATEGIES, NUMERIC_STRATEGIES

# Session setting with a JSON object of options, between the defaults and the overrides.
RULES_SETTING = "spark.tidewash.cleaningRules"


def one_of(*choices: str) -> Callable[[object], str]:
    def check(value: object) -> str:
        if str(value).lower() not in choices:
            raise ValueError(f"{value!r} is none of {', '.join(choices)}")
        return str(value).lower()

    return check


def flag(value: object) -> bool:
    if value not in (True, False):  # 0 and 1 equal these
        raise ValueError(f"{value!r} is no yes or no")
    return bool(value)


def maybe(kind: Callable) -> Callable:
    return lambda value: None if value is None else kind(value)


def option(default, check: Callable):
    """A field whose given values go through ``check``."""
    return field(default=default, metadata={"check": check})


@dataclass(frozen=True)
class CleaningRules:
    fill_missing_numeric: str = option("median", one_of(*NUMERIC_STRATEGIES))
    fill_missing_categorical: str = option("mode", one_of(*CATEGORICAL_STRATEGIES))
    drop_duplicates: bool = option(True, flag)
    trim_strings: bool = option(True, flag)
    drop_empty_columns: bool = option(True, flag)
    convert_types: bool = option(True, flag)
    remove_outliers: bool = option(False, flag)
    outlier_threshold: float = option(1.5, float)
    fill_value_numeric: float | None = option(None, maybe(float))
    fill_value_categorical: str | None = option(None, maybe(str))

    def __post_init__(self) -> None:
        for f in fields(self):
            try:
                object.__setattr__(self, f.name, f.metadata["check"](getattr(self, f.name)))
            except (TypeError, ValueError) as e:
                raise ValueError(f"Cleaning option {f.name}: {e}") from e
        for strategy, value in ((self.fill_missing_numeric, self.fill_value_numeric), (self.fill_missing_categorical, self.fill_value_categorical)):
            if strategy == "fixed" and value is None:
                raise ValueError("A fixed filling needs its fill_value option")

    @classmethod
    def of(cls, overrides: Mapping | CleaningRules | None = None, spark: SparkSession | None = None) -> CleaningRules:
        """Overrides beat the session setting, which beats the defaults. Unknown options are errors
        in either; a setting that is no JSON object counts as unset."""
        if isinstance(overrides, cls):
            return overrides
        options = {**_setting(spark), **_mapping(overrides)}
        if unknown := sorted(set(options) - {f.name for f in fields(cls)}):
            raise ValueError(f"No such cleaning option: {', '.join(map(str, unknown))}")
        return cls(**options)

    def as_dict(self) -> dict:
        return asdict(self)


def _mapping(given) -> Mapping:
    if not isinstance(given or {}, Mapping):
        raise ValueError(f"Cleaning options come as a mapping, not as {type(given).__name__}")
    return given or {}


def _setting(spark: SparkSession | None) -> Mapping:
    text = spark.conf.get(RULES_SETTING, None) if spark else None
    try:
        found = json.loads(text or "{}")
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}
