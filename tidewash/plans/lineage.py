"""Audit trail of a run: what each step did to the table, in order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Event:
    """One step; ``details`` are named facts, shown as text."""

    action: str
    reason: str
    affected_count: int
    column: str | None = None
    details: Mapping[str, object] = field(default_factory=dict)
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


def shown(value: object) -> str:
    return ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def lineage_table(spark: SparkSession, events: list[Event]) -> DataFrame:
    """The events as rows; times are UTC, details JSON objects of texts (null without any).

    Column names are fixed values.
    """
    rows = [(e.at.strftime("%Y-%m-%dT%H:%M:%S.%f"), e.action, e.column, e.reason, e.affected_count, {k: shown(v) for k, v in e.details.items()}) for e in events]
    kinds = "timestamp string, action string, column string, reason string, affected_count bigint, details map<string,string>"
    return spark.createDataFrame(rows, kinds).withColumn("details", F.when(F.size("details") > 0, F.to_json("details")))
