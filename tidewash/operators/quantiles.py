"""Exact quantiles by sketches and narrowing.

``percentile`` keeps every distinct value of a column in one aggregation buffer, which
does not fit once a column holds billions of them. Here a KLL sketch of each column, made in
the pass that counts its rows, brackets the wanted ranks; a second pass counts the values
inside the brackets and the rows between them, which settles the answers. Where brackets hold
too many rows for that (beyond some 10^7 rows in all), they are counted by bins
(at most ``BINS`` groups per bracket, combined before the shuffle), and further passes narrow to
the bins that hold the wanted ranks. A bin carries its own smallest and largest
value, so a bin full of copies of one value is an answer, however many rows it has. A rank that
its bracket misses is narrowed from the gap that holds it, columns with infinities from the whole range.
Each pass is one aggregation over the needed columns for all of them together. Values are told
apart by column and compared with the ends of intervals, which are looked up by column, after they are laid out one to a
row: so the code that Spark makes stays short. With tests and bins spelled out for each column it passes
8,000 bytes of bytecode for eight columns, and the JVM interprets such a method instead of compiling it.
The sketches are random, the result is exact: linear interpolation between neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col
from .columns import floating_columns, integral_columns

BINS = 4096
TINY = 1e-290
# An interval with at most this many rows is resolved by counting its single values.
SMALL_INTERVAL = 100_000
# Size of a sketch, and how far a bracket reaches on either side of its rank: three times its error.
SKETCH_SIZE, SKETCH_MARGIN = 4000, 0.003
# More tests than this on the rows of a scan are code that the JVM does not compile.
MAX_TESTS = 24
# A pass that keeps more than this share of an interval met a long tail.
STUBBORN_SHARE = 1 / 8


@dataclass(frozen=True)
class Bounds:
    """Count and range of the values of one numeric column (NaN and null left out), and the values a
    little below and above each probability that was asked for."""

    rows: int
    low: float | None
    high: float | None
    around: Mapping[float, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class _Interval:
    column: str
    low: float
    high: float
    rows: int
    ranks: dict[int, int]  # rank inside the interval -> rank in the column
    binary: bool = False  # one bin per power of two instead of equal widths

    @property
    def small(self) -> bool:
        return self.rows <= SMALL_INTERVAL


def as_double(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN taken for null (only floating columns hold NaN)."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value) if floating_columns(df, [name]) else value


def near_quantiles(value: Column, probabilities: Sequence[float]) -> Column:
    """Aggregate for :func:`around`: values near the probabilities, from a sketch; null without values."""
    places = [min(max(p + m, 0.0), 1.0) for p in probabilities for m in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(p) for p in places])))


def around(values: Sequence[float] | None, probabilities: Sequence[float]) -> dict[float, tuple[float, float]]:
    """What ``near_quantiles`` found, by probability."""
    return {p: (values[2 * i], values[2 * i + 1]) for i, p in enumerate(probabilities)} if values else {}


def column_bounds(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, Bounds]:
    if not columns:
        return {}
    values = [as_double(df, c) for c in columns]
    row = df.agg(*[a for v in values for a in (F.count(v), F.min(v), F.max(v), near_quantiles(v, probabilities))]).first()
    return {c: Bounds(*row[4 * i : 4 * i + 3], around(row[4 * i + 3], probabilities)) for i, c in enumerate(columns)}


def _finite_part(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, Bounds]]:
    """(number of negative infinities, bounds of the finite values) of each column."""
    inf, flat = F.lit(float("inf")), []
    for c in columns:
        v = as_double(df, c)
        finite = F.when(F.abs(v) < inf, v)
        flat += [F.count_if(v == -inf), F.count(finite), F.min(finite), F.max(finite)]
    row = df.agg(*flat).first()
    return {c: (row[4 * i], Bounds(*row[4 * i + 1 : 4 * i + 4])) for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    bounds: dict[str, Bounds] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of each column, linearly interpolated; ``None`` for an empty column."""
    bounds = bounds or column_bounds(df, columns, probabilities)
    positions = {c: [(bounds[c].rows - 1) * p for p in probabilities] for c in columns if bounds[c].rows}
    wanted = {
        c: sorted({r for p in ps for r in (math.floor(p), math.ceil(p))}) for c, ps in positions.items()
    }
    found = _order_statistics(df, wanted, bounds)

    def at(c: str, position: float) -> float:
        below, above = found[c, math.floor(position)], found[c, math.ceil(position)]
        share = position - math.floor(position)
        # Weighted apart, so that no difference of two values can overflow.
        return below if below == above or not share else below * (1 - share) + above * share

    return {c: [at(c, p) for p in positions[c]] if c in positions else [None] * len(probabilities) for c in columns}


def _order_statistics(df, wanted, bounds) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    intervals: list[_Interval] = []
    unbounded = [c for c in wanted if math.isinf(bounds[c].low) or math.isinf(bounds[c].high)]
    finite = _finite_part(df, unbounded) if unbounded else {}
    for c, ranks in wanted.items():
        below, b = finite.get(c, (0, bounds[c]))
        found.update({(c, r): float("-inf") for r in ranks if r < below})
        found.update({(c, r): float("inf") for r in ranks if r >= below + b.rows})
        inner = {r - below: r for r in ranks if below <= r < below + b.rows}
        if inner:
            intervals.append(_Interval(c, b.low, b.high, b.rows, inner))

    whole, narrowed = _bracketed(df, _settled(intervals, found), bounds)
    intervals = whole + narrowed
    while intervals := _settled(intervals, found):
        large = [x for x in intervals if not x.small]
        counted = large or intervals
        intervals = [x for x in intervals if x.small] if large else []
        for hit in _ranked_bins(df, counted, by_value=not large, skip_rows=not whole).collect():
            parent = counted[hit.interval]
            ranks = {r - hit.before: t for r, t in parent.ranks.items() if 0 <= r - hit.before < hit.rows}
            stubborn = not parent.binary and hit.rows > parent.rows * STUBBORN_SHARE
            binary = stubborn and _many_magnitudes(hit.low, hit.high)
            intervals.append(_Interval(parent.column, hit.low, hit.high, hit.rows, ranks, binary))
        whole = False
    return found


def _bracketed(df: DataFrame, intervals: list[_Interval], bounds: dict[str, Bounds]) -> tuple[list[_Interval], list[_Interval]]:
    """Of the intervals (whole columns), those without sketches, and the others narrowed to what
    their sketches' brackets, or the gaps around them, hold of the wanted ranks."""
    some = [x for x in intervals if bounds[x.column].around and not math.isinf(bounds[x.column].low) and not math.isinf(bounds[x.column].high)]
    narrowed = []
    for hit in _bracket_counts(df, some, bounds).collect() if some else []:
        x = some[hit.slot]
        mine = {r - hit.before: t for r, t in x.ranks.items() if 0 <= r - hit.before < hit.rows}
        narrowed.append(_Interval(x.column, hit.low, hit.high, hit.rows, mine))
    return [x for x in intervals if x not in some], narrowed


def _bracket_counts(df: DataFrame, intervals: list[_Interval], bounds: dict[str, Bounds]) -> DataFrame:
    """The parts of brackets, and the gaps, that hold wanted ranks: ``slot, low, high, rows, before``.

    One aggregation: each value is either in a bracket, where it counts by itself or by bin, or in one
    of the gaps around them, which are counted as a whole.
    """
    brackets, by_value = [], []
    for x in intervals:
        pieces: list[_Interval] = []
        for low, high in sorted(bounds[x.column].around.values()):
            if pieces and low <= pieces[-1].high:
                low, high = pieces[-1].low, max(pieces.pop().high, high)
            pieces.append(_Interval(x.column, low, high, 0, {}))
        brackets.append(pieces)
        by_value.append(2 * SKETCH_MARGIN * len(bounds[x.column].around) * x.rows <= SMALL_INTERVAL)
    most = max(map(len, brackets))
    # Gaps have even numbers, brackets odd ones. Brackets that a column lacks lie above all its values.
    place = "".join(
        f" WHEN v < {_by_slot([p[i].low if i < len(p) else math.inf for p in brackets])} THEN {2 * i}"
        f" WHEN v <= {_by_slot([p[i].high if i < len(p) else math.inf for p in brackets])} THEN {2 * i + 1}"
        for i in range(most)
    )
    bins = _bins([p[i] if i < len(p) else None for p in brackets for i in range(most)], f"slot * {most} + shiftright(k, 1) + 1")
    wide, cells = _laid_out(df, [x.column for x in intervals])
    ranks = ", ".join(f"array({', '.join(f'{r}L' for r in x.ranks)})" for x in intervals)
    return df.sparkSession.sql(
        f"""
        WITH placed_cells AS (
          SELECT slot, v, CASE{place} ELSE {2 * most} END AS k FROM {cells} WHERE v IS NOT NULL AND NOT isnan(v)),
        binned AS (
          SELECT slot, k, v, CASE WHEN k % 2 = 0 THEN NULL WHEN {_by_slot(by_value)} THEN v ELSE CAST({bins} AS DOUBLE) END AS g
          FROM placed_cells),
        counts AS (SELECT slot, k, count(*) AS rows, min(v) AS low, max(v) AS high FROM binned GROUP BY slot, k, g),
        placed AS (SELECT *, sum(rows) OVER (PARTITION BY slot ORDER BY low) - rows AS before FROM counts)
        SELECT slot, low, high, rows, before FROM placed
        WHERE exists(element_at(array({ranks}), slot + 1), r -> r >= before AND r < before + rows)
        """,
        wide=wide,
    )


def _settled(intervals: list[_Interval], found: dict) -> list[_Interval]:
    """Record the intervals that hold one value; return the others."""
    for x in intervals:
        if x.low == x.high:
            found.update({(x.column, t): x.low for t in x.ranks.values()})
    return [x for x in intervals if x.low < x.high]


def _many_magnitudes(low: float, high: float) -> bool:
    if low <= 0 <= high:
        return True
    small, large = sorted((abs(low), abs(high)))
    return large / BINS > small


def _laid_out(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, str]:
    """The columns as doubles, and SQL that lays them out as rows ``slot, v``: the column's place and a value."""
    names = ["`" + c.replace("`", "``") + "`" for c in columns]
    wide = df.selectExpr(*[cell for i, c in enumerate(names) for cell in (f"{i} AS k{i}", f"CAST({c} AS DOUBLE) AS v{i}")])
    return wide, f"{{wide}} UNPIVOT ((slot, v) FOR name IN ({', '.join(f'(k{i}, v{i}) AS s{i}' for i in range(len(names)))}))"


def _by_slot(values: Sequence[float | int | bool], index: str = "slot + 1") -> str:
    """SQL for the value at the place ``index`` (from 1)."""

    def text(v) -> str:
        if not isinstance(v, float):
            return str(v)
        return f"{v!r}D" if math.isfinite(v) else f"DOUBLE('{v}')"

    return f"element_at(array({', '.join(map(text, values))}), {index})"


def _bins(intervals: Sequence[_Interval | None], index: str) -> str:
    """SQL for a whole number, of some thousand, that never decreases as ``v`` grows within the
    interval at the place ``index`` (from 1)."""
    scales = [_scale(x) if x and x.low < x.high else (0.0, 0.0, 0.0, 0.0) for x in intervals]
    by, less, first, then = (_by_slot(part, index) for part in zip(*scales))
    width = f"least(floor((v * {by} - {less}) * {first} * {then}), {BINS - 1})"
    if not any(x and x.binary for x in intervals):
        return width
    power = "(CAST(floor(log2(abs(v))) AS BIGINT) + 1100)"
    binary = _by_slot([bool(x and x.binary) for x in intervals], index)
    return f"CASE WHEN NOT {binary} THEN {width} WHEN v > 0 THEN {power} WHEN v < 0 THEN -{power} ELSE 0 END"


def _scale(x: _Interval) -> tuple[float, float, float, float]:
    """What ``v`` is multiplied by, what is taken off, and two factors that make a bin number of it."""
    half = x.high / 2 - x.low / 2
    if half < TINY:  # scaled up in two factors, as one would overflow
        return 1.0, x.low, 2.0**200, BINS / ((x.high - x.low) * 2.0**200)
    return 0.5, x.low / 2, 1.0, BINS / half  # halves keep the width finite for a range wider than the largest double


def _within(df: DataFrame, name: str, interval: _Interval) -> str:
    """SQL test on the column itself, so that a scan can use it. NaN is in no interval."""
    column = "`" + name.replace("`", "``") + "`"
    if integral_columns(df, [name]) and max(abs(interval.low), abs(interval.high)) < 2**53:
        return f"{column} BETWEEN {math.ceil(interval.low)}L AND {math.floor(interval.high)}L"
    return f"CAST({column} AS DOUBLE) BETWEEN {interval.low!r}D AND {interval.high!r}D"


def _ranked_bins(df: DataFrame, intervals: list[_Interval], by_value: bool, skip_rows: bool) -> DataFrame:
    """The bins that hold wanted ranks: ``interval, low, high, rows, before``.

    ``by_value`` makes every value a bin of its own (for small intervals).
    """
    by_column: dict[str, list[tuple[int, _Interval]]] = {}
    for i, interval in enumerate(intervals):
        by_column.setdefault(interval.column, []).append((i, interval))

    slots = list(by_column.values())
    most = max(map(len, slots))
    # Intervals that a column lacks hold no value.
    place = "".join(
        f" WHEN v BETWEEN {_by_slot([mine[i][1].low if i < len(mine) else math.inf for mine in slots])}"
        f" AND {_by_slot([mine[i][1].high if i < len(mine) else -math.inf for mine in slots])}"
        f" THEN {_by_slot([mine[i][0] if i < len(mine) else -1 for mine in slots])}"
        for i in range(most)
    )
    tests = [_within(df, x.column, x) for x in intervals]
    if skip_rows and len(tests) <= MAX_TESTS:
        df = df.filter(" OR ".join(f"({t})" for t in tests))
    wide, cells = _laid_out(df, list(by_column))
    ranks = ", ".join(f"array({', '.join(f'{r}L' for r in x.ranks)})" for x in intervals)
    # At most some thousand (or SMALL_INTERVAL) rows per interval reach the window.
    return df.sparkSession.sql(
        f"""
        WITH placed_cells AS (SELECT v, CASE{place} END AS interval FROM {cells}),
        binned AS (
          SELECT interval, v, {'v' if by_value else _bins(intervals, 'interval + 1')} AS g FROM placed_cells WHERE interval IS NOT NULL),
        counts AS (SELECT interval, count(*) AS rows, min(v) AS low, max(v) AS high FROM binned GROUP BY interval, g),
        placed AS (SELECT *, sum(rows) OVER (PARTITION BY interval ORDER BY low) - rows AS before FROM counts)
        SELECT interval, low, high, rows, before FROM placed
        WHERE exists(element_at(array({ranks}), interval + 1), r -> r >= before AND r < before + rows)
        """,
        wide=wide,
    )
