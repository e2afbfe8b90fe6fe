"""Column expressions: everything here returns an unevaluated ``Column``."""

from .dates import parse_timestamp
from .numbers import (
    finite_or_null,
    nan_to_null,
    number_from_pattern,
    number_with_unit,
    parse_number,
    standard_units,
    to_number,
)
from .text import blank_to_null, col, null_tokens, spreadsheet_text, strip, word_count

__all__ = [
    "blank_to_null",
    "col",
    "finite_or_null",
    "nan_to_null",
    "null_tokens",
    "number_from_pattern",
    "number_with_unit",
    "parse_number",
    "parse_timestamp",
    "spreadsheet_text",
    "standard_units",
    "strip",
    "to_number",
    "word_count",
]
