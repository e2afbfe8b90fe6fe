"""Text expressions: stripping, missing tokens, spreadsheet-safe text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# Characters removed from both ends of a cell: every character with the Unicode
# white-space property plus the four ASCII separators 1C-1F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts the cleaning stage turns into null.
MISSING_TOKENS = ("", "NA", "N/A", "NULL", "null", "None", "none")

# Cell texts the CSV reader turns into null.
READER_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Spreadsheet cells: characters not allowed, and the longest text that fits.
CONTROL_CHARACTERS = r"[\x00-\x08\x0B-\x0C\x0E-\x1F]"
SPREADSHEET_CELL_LENGTH = 32767
# ----------------------------------------------------------------------------


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_sql(c: str) -> str:
    """``strip`` as SQL text around the SQL text ``c``."""
    return f"btrim({c}, '{''.join(f'{chr(92)}u{ord(x):04x}' for x in WHITESPACE)}')"


def blank_to_null(c: Column) -> Column:
    """Null for a cell that is empty or only white space; otherwise unchanged."""
    return F.when(strip(c) != "", c)


def null_tokens(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Null for a cell equal to one of ``tokens``; otherwise unchanged."""
    return F.when(~c.isin(*tokens), c)


def word_count(s: Column) -> Column:
    """Number of white-space separated words of a stripped cell (0 for no text)."""
    # One character for each word and the white space around it, rather than an array of all words.
    return F.length(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]*+[^\s\x1c-\x1f]++[\s\x1c-\x1f]*+", "x"))


def spreadsheet_text(c: Column, length: int = SPREADSHEET_CELL_LENGTH) -> Column:
    """Drop control characters and cut to the longest text a cell can hold."""
    return F.substring(F.regexp_replace(c, CONTROL_CHARACTERS, ""), 1, length)


def exceeds_cell(c: Column, length: int = SPREADSHEET_CELL_LENGTH) -> Column:
    """Whether ``spreadsheet_text`` cuts the text."""
    return F.length(F.regexp_replace(c, CONTROL_CHARACTERS, "")) > length
