"""Mixed-format date parsing without a per-row parser call.

Each accepted shape is a pattern plus the ISO text it stands for; the ISO text goes
through one ``try_cast`` to TIMESTAMP_NTZ. That cast neither raises nor depends on the
session time zone, and a cell that fits no shape costs only a short anchored match.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_sql


@dataclass(frozen=True)
class DateShape:
    """``pattern`` recognises a cell, ``iso`` rewrites it (``$n`` = capture group)."""

    pattern: str
    iso: str


# --- Fixed values -----------------------------------------------------------
_TIME = r"(?:[T ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?"

# Tried in this order. Month first; day first only where the month would exceed 12.
_EARLY, _LATE = "([0-5][0-9]|6[0-8])", "(69|[7-9][0-9])"  # two-digit years of 2000 and of 1900
DATE_SHAPES = (
    DateShape(rf"^(\d{{4}})[/.-](\d{{1,2}})[/.-](\d{{1,2}}){_TIME}$", "$1-$2-$3 $4"),
    DateShape(rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}$", "$1-$2-$3 $4"),
    DateShape(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_TIME}$", "$3-$1-$2 $4"),
    DateShape(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_TIME}$", "$3-$2-$1 $4"),
    DateShape(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-]{_EARLY}{_TIME}$", "20$3-$1-$2 $4"),
    DateShape(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-]{_LATE}{_TIME}$", "19$3-$1-$2 $4"),
    DateShape(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-]{_EARLY}{_TIME}$", "20$3-$2-$1 $4"),
    DateShape(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-]{_LATE}{_TIME}$", "19$3-$2-$1 $4"),
)

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MONTH_NAME = (
    r"(?i:(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?"
    r"|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?))"
)
_WEEKDAY = r"(?i:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?,? +)"
_UTC = r"(?: *(?:GMT|UTC|[+-]0000))?"
# "5 January 2024", "5-Jan-24", "Fri, 05 Jan 2024 10:00 GMT" and "January 5, 2024", with an optional time.
DAY_MONTH_NAME = rf"^{_WEEKDAY}?(\d{{1,2}})[ -]{_MONTH_NAME}[ ,-]+(\d{{4}}|\d{{2}}){_TIME}{_UTC}$"
MONTH_NAME_DAY = rf"^{_WEEKDAY}?{_MONTH_NAME}[ -]+(\d{{1,2}})[, -]+(\d{{4}}){_TIME}{_UTC}$"
# A time that ends in AM or PM.
HALF_DAY = r"(?i)(\d{1,2})((?::\d{2}){1,2}) ?([ap])\.?m\.?$"
# Longer than such a time, and than a weekday or month with the blank behind it.
GUARD_LENGTH = 16

# ISO date-time with a UTC offset; the result is the UTC wall clock.
ISO_OFFSET = r"^(\d{4}-\d{1,2}-\d{1,2})[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?(?:Z|([+-])(\d{2}):?(\d{2}))$"
# ----------------------------------------------------------------------------


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _cast(iso: str) -> str:
    return f"try_cast(btrim({iso}) AS TIMESTAMP_NTZ)"


def _rewritten(s: str, shape: DateShape) -> str:
    pattern, iso = _quoted(shape.pattern), _quoted(shape.iso)
    return f"CASE WHEN {s} RLIKE {pattern} THEN {_cast(f'regexp_replace({s}, {pattern}, {iso})')} END"


def _named_month(s: str, pattern: str, day: int, month: int) -> str:
    def group(n: int) -> str:
        return f"regexp_extract({s}, {_quoted(pattern)}, {n})"

    place = f"instr('{''.join(MONTHS)}', initcap(lower(substr({group(month)}, 1, 3))))"
    year = f"concat(CASE WHEN length({group(3)}) > 2 THEN '' WHEN {group(3)} < '69' THEN '20' ELSE '19' END, {group(3)})"
    iso = f"concat({year}, '-', ({place} + 2) div 3, '-', {group(day)}, ' ', {group(4)})"
    return f"CASE WHEN {s} RLIKE {_quoted(pattern)} THEN {_cast(iso)} END"


def _with_offset(s: str) -> str:
    def group(n: int) -> str:
        return f"regexp_extract({s}, {_quoted(ISO_OFFSET)}, {n})"

    def part(n: int) -> str:
        return f"coalesce(try_cast({group(n)} AS INT), 0) * if({group(3)} = '-', 1, -1)"

    local = _cast(f"concat_ws(' ', {group(1)}, {group(2)})")
    return f"CASE WHEN {s} RLIKE {_quoted(ISO_OFFSET)} THEN {local} + make_dt_interval(0, {part(4)}, {part(5)}) END"


def _attempts(s: str, shapes: Sequence[DateShape]) -> str:
    found = [_rewritten(s, x) for x in shapes]
    found += [_with_offset(s), _named_month(s, DAY_MONTH_NAME, 1, 2), _named_month(s, MONTH_NAME_DAY, 2, 1)]
    return f"coalesce({', '.join(found)})"


def _guards(s: str) -> tuple[str, str]:
    """SQL tests of a stripped text: whether it ends like a time of half a day, and whether it starts like a
    date. Every shape starts with a digit, a weekday or a month name. Neither looks at more than a few characters."""
    start = _quoted(rf"^\d|^{_MONTH_NAME}[ -]|^{_WEEKDAY}")
    return f"right({s}, {GUARD_LENGTH}) RLIKE {_quoted(HALF_DAY)}", f"left({s}, {GUARD_LENGTH}) RLIKE {start}"


def maybe_timestamp(name: str) -> Column:
    """Whether ``parse_timestamp`` looks at the stripped text column ``name`` at all; a short test, unlike the parsing."""
    return F.expr(" OR ".join(_guards("`" + name.replace("`", "``") + "`")))


def timestamp_sql(s: str, shapes: Sequence[DateShape] = DATE_SHAPES) -> str:
    """SQL text of the conversion of a stripped text ``s`` (itself SQL)."""
    halved_day, dated = _guards(s)
    half = _quoted(HALF_DAY)
    hour, letter = f"try_cast(regexp_extract({s}, {half}, 1) AS INT)", f"lower(regexp_extract({s}, {half}, 3))"
    # Twelve hours on for PM, and back for the hour 12: read as 24 hours first.
    shift = f"(CASE WHEN {letter} = 'p' THEN 12 ELSE 0 END) - (CASE WHEN {hour} = 12 THEN 12 ELSE 0 END)"
    plain = f"regexp_replace({s}, {half}, '$1$2')"
    halved = f"CASE WHEN {hour} BETWEEN 1 AND 12 THEN {_attempts(plain, shapes)} + make_dt_interval(0, {shift}) END"
    return f"CASE WHEN {halved_day} THEN {halved} WHEN {dated} THEN {_attempts(s, shapes)} END"


def parse_timestamp(name: str, shapes: Sequence[DateShape] = DATE_SHAPES, stripped: bool = False) -> Column:
    """Text column ``name`` to TIMESTAMP_NTZ over the accepted shapes; null when none fits.

    Built as SQL text: one call to the JVM instead of one per part of the expression.
    """
    column = "`" + name.replace("`", "``") + "`"
    return F.expr(timestamp_sql(column if stripped else strip_sql(column), shapes))
