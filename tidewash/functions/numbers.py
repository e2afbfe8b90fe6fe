"""Numeric expressions: guarded parsing, unit extraction, unit scaling."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# --- Fixed values -----------------------------------------------------------
# A decimal number as text. Spark's own cast also takes "5d", "8F" and "0x1p3",
# which are not numbers here, so every cast is guarded by this pattern.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
INFINITE = r"^[+-]?(?i:inf|infinity)$"
NUMBER_CHARACTERS = r"(?U)^[\d+\-.,\seEinftyINFTY]+$"
WHOLE_NUMBER = r"^[+-]?\d+$"

# Number followed by a unit word, from the start of the cell: "512GB SSD" -> 512.
NUMBER_WITH_UNIT = r"^([+-]?(?:\d+\.?\d*|\.\d+))\s*[a-zA-Z]+"

# Factor from a unit to the standard unit of its family.
UNIT_FACTORS = {
    "GB": {"MB": 1 / 1024, "GB": 1.0, "TB": 1024.0},
    "kg": {"g": 1 / 1000, "kg": 1.0, "lb": 0.453592},
    "inches": {"cm": 0.393701, "inches": 1.0, "mm": 0.0393701},
}
# ----------------------------------------------------------------------------


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


# The parsers strip the cell themselves unless told that it is ``stripped`` already.


def _stripped(c: Column, stripped: bool) -> Column:
    return c if stripped else strip(c)


def parse_number(c: Column, stripped: bool = False) -> Column:
    """Text to DOUBLE; anything that is not a plain number becomes null."""
    s = _stripped(c, stripped)
    infinity = F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(NUMBER), s.try_cast("double")).when(s.rlike(INFINITE), infinity)


def parse_whole_number(c: Column, stripped: bool = False) -> Column:
    s = _stripped(c, stripped)
    return F.when(s.rlike(WHOLE_NUMBER), s.try_cast("bigint"))


def parse_boolean(c: Column) -> Column:
    """The spellings a CSV reader takes for booleans, in any of three cases."""
    return F.when(c.isin("True", "TRUE", "true"), True).when(c.isin("False", "FALSE", "false"), False)


def to_number(c: Column, stripped: bool = False) -> Column:
    """``parse_number`` after deleting thousands commas and blanks."""
    s = _stripped(c, stripped)
    # Only cells made of characters a number can hold are worth rewriting.
    return F.when(s.rlike(NUMBER_CHARACTERS), parse_number(F.translate(s, ", ", "")))


def number_with_unit(c: Column, stripped: bool = False) -> Column:
    """Leading number of a cell like ``8GB``; null without a unit word after it."""
    found = F.regexp_extract(_stripped(c, stripped), NUMBER_WITH_UNIT, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def number_from_pattern(c: Column, pattern: str | None) -> Column:
    """First capture group of the first match, as a number.

    Without a pattern, or with one that captures nothing, the cell itself is parsed.
    """
    if not pattern or re.compile(pattern).groups == 0:
        return parse_number(c)
    return parse_number(F.regexp_extract(c, pattern, 1))


def default_unit_pattern(unit: str) -> str:
    """Value-and-unit pattern for the units convertible to ``unit``.

    Longer spellings first, so that ``g`` does not match inside ``kg``-like names.
    """
    names = sorted(UNIT_FACTORS[unit], key=lambda u: (-len(u), u))
    return r"(\d+\.?\d*)\s*(" + "|".join(names) + ")"


def unit_parts(c: Column, pattern: str) -> tuple[Column, Column]:
    """(value, unit) captured by the first two groups of ``pattern``."""
    return parse_number(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2)


def standard_units(c: Column, unit: str, pattern: str | None = None) -> Column:
    """Value in the standard unit; a unit outside the family keeps the raw value."""
    value, found = unit_parts(c, pattern or default_unit_pattern(unit))
    factor = F.lit(1.0)
    for name, scale in UNIT_FACTORS[unit].items():
        if scale != 1.0:
            factor = F.when(found == name, F.lit(scale)).otherwise(factor)
    return value * factor
