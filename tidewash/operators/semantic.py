"""Semantic type of each column, decided from match ratios and column statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, parse_timestamp, strip, word_count
from ..functions.dates import maybe_timestamp
from .columns import (
    boolean_columns,
    data_columns,
    datetime_columns,
    integral_columns,
    numeric_columns,
    string_columns,
)
from .quantiles import as_double
from .stats import batches, distinct_counts

# --- Fixed values -----------------------------------------------------------
# Patterns of the trimmed cell; (?U) gives \w and \s their Unicode meaning.
EMAIL = r"(?iU)^[\w.+-]+@[\w-]+\.[a-z]{2,}$"
PHONE = r"(?U)^\+?[\d\s\-().]{7,15}$"
URL = r"(?i)^https?://"
PERCENT_SIGN = "%"
CURRENCY_SIGNS = ("$", "£", "€", "₹", "¥")
# Text rules in order, each with the share of cells that must exceed it.
TEXT_RULES = (
    ("EMAIL", 0.7),
    ("DATE_STRING", 0.7),
    ("PHONE_NUMBER", 0.7),
    ("URL", 0.7),
    ("PERCENTAGE", 0.7),
    ("CURRENCY", 0.6),
)
# Free text: so many words on average, or fewer when most values differ.
FREE_TEXT_WORDS, FREE_TEXT_WORDS_IF_VARIED, VARIED_RATIO = 5.0, 3.0, 0.50
# Categories: few values that repeat a lot, or more values that still repeat.
LOW_CARDINALITY, LOW_RATIO, HIGH_RATIO = 20, 0.10, 0.50
LATITUDE_NAMES, LONGITUDE_NAMES = ("lat",), ("lon", "lng")
CURRENCY_NAMES = ("price", "cost", "salary", "revenue", "fee")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TextEvidence:
    values: int
    shares: dict[str, float]
    mean_words: float


def _stripped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as ``s0, s1, …``, each stripped once for all tests."""
    return df.select(*[strip(col(c)).alias(f"s{i}") for i, c in enumerate(columns)])


def _text_tests(name: str, dates: bool = True) -> dict[str, Column]:
    """The test of each text rule on a stripped column. Cheap tests guard the patterns. Without ``dates``, cells
    that only start or end like one count as dates: parsing them is too long for Spark's compiler."""
    s = F.col(name)
    return {
        "EMAIL": s.contains("@") & s.rlike(EMAIL),
        "DATE_STRING": parse_timestamp(name, stripped=True).isNotNull() if dates else maybe_timestamp(name),
        "PHONE_NUMBER": F.length(s).between(7, 16) & s.rlike(PHONE),
        "URL": s.rlike(URL),
        "PERCENTAGE": s.endswith(PERCENT_SIGN),
        "CURRENCY": F.substring(s, 1, 1).isin(*CURRENCY_SIGNS),
    }


def _text_aggregates(i: int, dates: bool = True) -> list[Column]:
    """Counts behind the text rules: non-null cells, words, then matches per rule."""
    s, tests = F.col(f"s{i}"), _text_tests(f"s{i}", dates)
    counts = [F.count(s), F.avg(word_count(s)), *[F.count_if(tests[kind]) for kind, _ in TEXT_RULES]]
    return [a.alias(f"a{i}_{j}") for j, a in enumerate(counts)]


def text_ratios(df: DataFrame) -> DataFrame:
    """``column, semantic_type, ratio`` of each text rule over each string column."""
    entries, aggregates = [], []
    for i, name in enumerate(string_columns(df)):
        aggregates += _text_aggregates(i)
        for j, (kind, _) in enumerate(TEXT_RULES):
            ratio = F.col(f"a{i}_{j + 2}") / F.greatest(F.col(f"a{i}_0"), F.lit(1))
            entries.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("semantic_type"), ratio.alias("ratio")))
    return _stripped(df, string_columns(df)).agg(*aggregates).select(F.inline(F.array(*entries)))


def _text_evidence(df: DataFrame, columns: list[str]) -> dict[str, TextEvidence]:
    width = len(TEXT_RULES) + 2
    flat = [a for i in range(len(columns)) for a in _text_aggregates(i, dates=False)]
    row = _stripped(df, columns).agg(F.count(F.lit(1)), *flat).first()
    evidence = {}
    for i, c in enumerate(columns):
        values, words, *matches = row[1 + i * width : 1 + (i + 1) * width]
        shares = {kind: m / values if values else 0.0 for (kind, _), m in zip(TEXT_RULES, matches)}
        evidence[c] = TextEvidence(values, shares, words or 0.0)
    # Only columns with enough cells that may be dates need the number of those that are.
    dated = [c for c, e in evidence.items() if e.shares["DATE_STRING"] > dict(TEXT_RULES)["DATE_STRING"]]
    if dated:
        found = _stripped(df, dated).agg(*[F.count_if(_text_tests(f"s{i}")["DATE_STRING"]).alias(f"a{i}") for i in range(len(dated))]).first()
        for c, n in zip(dated, found):
            evidence[c].shares["DATE_STRING"] = n / evidence[c].values
    return evidence


def _by_pattern(e: TextEvidence) -> str | None:
    for kind, share in TEXT_RULES:
        if e.shares[kind] > share:
            return kind
    return "FREE_TEXT" if e.mean_words >= FREE_TEXT_WORDS else None


def _by_cardinality(e: TextEvidence, unique: int, rows: int) -> str:
    ratio = unique / max(rows, 1)
    if ratio > VARIED_RATIO and e.mean_words >= FREE_TEXT_WORDS_IF_VARIED:
        return "FREE_TEXT"
    if unique < LOW_CARDINALITY and ratio < LOW_RATIO:
        return "CATEGORICAL_LOW"
    if unique >= LOW_CARDINALITY and ratio < HIGH_RATIO:
        return "CATEGORICAL_HIGH"
    return "UNKNOWN"


def _by_range_and_name(name: str, low: float, high: float) -> str | None:
    lowered = name.lower()

    def named(parts) -> bool:
        return any(p in lowered for p in parts)

    if 0 <= low and high <= 1:
        return "PERCENTAGE"
    if named(LATITUDE_NAMES) and -90 <= low and high <= 90:
        return "LATITUDE"
    if named(LONGITUDE_NAMES) and -180 <= low and high <= 180:
        return "LONGITUDE"
    if named(CURRENCY_NAMES):
        return "CURRENCY"
    return None


def infer_semantic_types(df: DataFrame) -> dict[str, str]:
    """``{column: type}``. One scan decides most columns.

    A second job counts distinct values, but only for text columns no pattern or word
    count decided and for whole-number columns that could still be all different: a
    column with more values than its range has whole numbers must repeat some.
    """
    types: dict[str, str] = dict.fromkeys(data_columns(df), "UNKNOWN")
    texts, numbers = string_columns(df), numeric_columns(df)
    whole, undecided = set(integral_columns(df)), {}
    rows = 0

    for batch in batches(numbers + datetime_columns(df) + boolean_columns(df)):
        flat = [F.count(F.lit(1))]
        for c in batch:
            v = as_double(df, c) if c in numbers else F.lit(None).cast("double")
            flat += [F.count(v) if c in numbers else F.count(col(c)), F.min(v), F.max(v)]
        row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(flat)]).first()
        rows = row[0]
        for i, c in enumerate(batch):
            values, low, high = row[1 + 3 * i : 4 + 3 * i]
            if not values:
                continue
            if c not in numbers:
                types[c] = "PERCENTAGE" if boolean_columns(df, [c]) else "DATE_STRING"
                continue
            types[c] = _by_range_and_name(c, low, high) or "NUMERIC_CONTINUOUS"
            # An identifier has no gaps.
            if types[c] == "NUMERIC_CONTINUOUS" and c in whole and values == rows and high - low + 1 >= values:
                undecided[c] = values

    evidence: dict[str, TextEvidence] = {}
    for batch in batches(texts):
        if batch:
            evidence.update(_text_evidence(df, batch))
    for c, e in evidence.items():
        if e.values:
            types[c] = _by_pattern(e) or "UNKNOWN"
            if types[c] == "UNKNOWN":
                undecided[c] = e.values

    if undecided:
        keys = [strip(col(c)).alias(c) if c in evidence else col(c) for c in undecided]
        unique = {r["column"]: r["distinct_count"] for r in distinct_counts(df.select(*keys)).collect()}
        for c, values in undecided.items():
            if c in evidence:
                types[c] = _by_cardinality(evidence[c], unique[c], rows)
            elif unique[c] == values:
                types[c] = "NUMERIC_ID"
    return types


def semantic_types_table(df: DataFrame) -> DataFrame:
    """``column, semantic_type``."""
    return df.sparkSession.createDataFrame(list(infer_semantic_types(df).items()), "column string, semantic_type string")
