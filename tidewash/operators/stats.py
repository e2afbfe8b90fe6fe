"""Column statistics shared by profiling, imputation, outliers and validation.

Every function reads all asked-for columns in the same aggregation. Wide tables are
read in batches of columns, which costs no extra input on a columnar table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ROW_ID
from ..functions import col
from .columns import (
    data_columns,
    first_rows,
    floating_columns,
    integral_columns,
    nested_columns,
    numeric_columns,
    string_columns,
)
from .quantiles import Bounds, around, as_double, exact_quantiles, near_quantiles

# Columns aggregated per job: keeps generated code within what the JVM compiles.
BATCH = 60
# Standard error of an estimated distinct count.
DISTINCT_ERROR = 0.02
# Characters of a text that travel with it in a shuffle, and candidates that the driver takes.
TEXT_HEAD = 32
FEW_CANDIDATES = 10_000
QUARTILES = (0.25, 0.5, 0.75)
IQR_FACTOR = 1.5


def batches(columns: Sequence[str], size: int = BATCH) -> list[list[str]]:
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)] or [[]]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN taken for null (only floating columns can hold NaN)."""
    c = col(name)
    if floating_columns(df, [name]):
        return F.when(~F.isnan(c), c)
    return c


# --- Missing values ---------------------------------------------------------
def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, row_count, missing_count, missing_percent`` (fraction, 6 digits)."""
    columns = data_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, row_count bigint, missing_count bigint, missing_percent double")
    parts = []
    for batch in batches(columns):
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(batch)])
        entries = [F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"c{i}")).alias("missing_count")) for i, c in enumerate(batch)]
        parts.append(counts.select("n", F.inline(F.array(*entries))))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionAll(part)
    share = F.round(F.col("missing_count") / F.greatest(F.col("n"), F.lit(1)), 6)
    return table.select("column", F.col("n").alias("row_count"), "missing_count", share.alias("missing_percent"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """(rows, nulls per column) on the driver: one number per column."""
    rows = missing_profile(df, columns).collect()
    return (rows[0]["row_count"] if rows else df.count()), {r["column"]: r["missing_count"] for r in rows}


# --- Distinct values and value counts ---------------------------------------
def _text_key(text: Column) -> Column:
    """What stands for a text in a shuffle: its first ``TEXT_HEAD`` characters and, if it is longer, 128 bits
    of all of it. Keys are equal if the texts are, and heads are in the order of the texts."""
    long = F.length(text) > TEXT_HEAD
    return F.when(text.isNotNull(), F.struct(F.left(text, F.lit(TEXT_HEAD)).alias("head"), F.when(long, F.xxhash64(text)).alias("h"), F.when(long, F.xxhash64(F.lit(1), text)).alias("g")))


def _long(df: DataFrame, cells: Sequence[Column], place: Column | None) -> DataFrame:
    """``slot, value`` (and ``place``) of the cells that are not null; slot is the cell's position."""
    names = [str(i) for i in range(len(cells))]
    wide = df.select(*[c.alias(n) for c, n in zip(cells, names)], *([] if place is None else [place.alias("place")]))
    return wide.unpivot([] if place is None else ["place"], names, "slot", "value").filter("value IS NOT NULL")


def text_candidates(df: DataFrame, texts: Sequence[Column], k: int, place: Column | None = None) -> DataFrame:
    """``slot, value, count, unique_count`` (and ``place``) of each text's keys that may be among the first ``k``:
    by count, most first, or by the least ``place``; then by text, as far as heads tell.

    Counts combine before the shuffle, so a hot value reaches it once per task, and no text
    longer than its head does. The ranking keeps few rows per column in each task.
    """
    counts = _long(df, [_text_key(t) for t in texts], place).groupBy("slot", "value").agg(
        F.count(F.lit(1)).alias("count"), *([] if place is None else [F.min("place").alias("place")]))
    order = Window.partitionBy("slot").orderBy(F.desc("count") if place is None else F.asc("place"), F.col("value.head"), F.col("value.h").isNotNull())
    top = counts.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= k).drop("rank")
    # The test always holds; it keeps "count" in use, so both sides read one shuffle.
    totals = counts.groupBy("slot").agg(F.count_if(F.col("count") > 0).alias("unique_count"))
    return top.join(totals, "slot")


def _first_texts(df: DataFrame, texts: Sequence[Column], k: int, place: Column | None = None) -> list[list[tuple]]:
    """For each text its first ``k`` values as (value, count, unique count), in the order of
    :func:`text_candidates`, ties by text. Long texts among the candidates are fetched by their
    keys in a second pass, which also counts them anew, so two texts of one key are told apart."""
    found = text_candidates(df, texts, k, place)
    rows = found.limit(FEW_CANDIDATES + 1).collect()
    few = len(rows) <= FEW_CANDIDATES
    long = found.filter("value.h IS NOT NULL")
    if few:
        long = df.sparkSession.createDataFrame([r for r in rows if r["value"]["h"] is not None], found.schema)
        short = [r for r in rows if r["value"]["h"] is None]
    else:
        short = found.filter("value.h IS NULL").collect()  # at most k for each text
    unique = {r["slot"]: r["unique_count"] for r in rows}
    if not few or len(short) < len(rows):
        whole = _long(df, [F.when(F.length(t) > TEXT_HEAD, F.struct(_text_key(t).alias("key"), t.alias("text"))) for t in texts], place)
        wanted = long.select("slot", F.col("value").alias("key"), "unique_count")
        met = whole.join(wanted, (whole["slot"] == wanted["slot"]) & (whole["value.key"] == wanted["key"])).select(whole["slot"], "value.text", "unique_count", *([] if place is None else ["place"]))
        counted = met.groupBy("slot", "text", "unique_count").agg(F.count(F.lit(1)).alias("count"), *([] if place is None else [F.min("place").alias("place")]))
        order = Window.partitionBy("slot").orderBy(F.desc("count") if place is None else F.asc("place"), F.asc("text"))
        fetched = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()
        unique.update({r["slot"]: r["unique_count"] for r in fetched})
    else:
        fetched = []
    out: list[list[tuple]] = [[] for _ in texts]
    for r in short:
        out[int(r["slot"])].append((-r["count"] if place is None else r["place"], r["value"]["head"], r["count"]))
    for r in fetched:
        out[int(r["slot"])].append((-r["count"] if place is None else r["place"], r["text"], r["count"]))
    for i, values in enumerate(out):
        values.sort(key=lambda v: (v[0], v[1].encode()))
        out[i] = [(text, count, unique[str(i)]) for _, text, count in values[:k]]
    return out


def _kinds(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Columns by the type their values are compared in: decimals each in their own."""
    whole, types, kinds = set(integral_columns(df, columns)), dict(df.dtypes), {}
    numbers = set(numeric_columns(df, columns)) - whole
    for c in columns:
        kind = "bigint" if c in whole else "string" if c not in numbers else types[c] if types[c].startswith("decimal") else "double"
        kinds.setdefault(kind, []).append(c)
    return list(kinds.items())


def _digest(text: Column) -> Column:
    """128 bits that stand for a text, so that long texts need not be sent; null for null."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")))


def _typed_counts(df: DataFrame, columns: Sequence[str], kind: str, digests: bool = False) -> DataFrame:
    """``slot, value, count`` of same-typed columns; slot is the column's position. With ``digests``
    texts are told apart by their digests, and those are the values."""
    cells = [present(df, c).cast(kind) for c in columns]
    values = df.select(*[(_digest(v) if digests and kind == "string" else v).alias(str(i)) for i, v in enumerate(cells)])
    long = values.unpivot([], values.columns, "slot", "value").filter("value IS NOT NULL")
    return long.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact ``column, distinct_count`` (nulls excluded), without one huge set per column."""
    columns = list(columns or data_columns(df))
    parts = []
    for kind, group in _kinds(df, columns):
        counted = _typed_counts(df, group, kind, digests=True).groupBy("slot").agg(F.count(F.lit(1)).alias("distinct_count"))
        names = F.element_at(F.array(*[F.lit(c) for c in group]), F.col("slot").cast("int") + 1)
        parts.append(counted.select(names.alias("column"), "distinct_count"))
    return _with_all_columns(reduce(DataFrame.unionAll, parts), columns, {"distinct_count": 0})


def estimated_distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, error: float = DISTINCT_ERROR
) -> DataFrame:
    """``column, distinct_count`` from HyperLogLog++ sketches (one scan, fixed state)."""
    columns = list(columns or data_columns(df))
    sketches = df.agg(*[F.approx_count_distinct(present(df, c), error).alias(f"c{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("distinct_count")) for i, c in enumerate(columns)]
    return sketches.select(F.inline(F.array(*entries)))


def _with_all_columns(df: DataFrame, columns: Sequence[str], fill: dict) -> DataFrame:
    """Add a row for each column without any value."""
    rows = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return rows.join(df, "column", "left").fillna(fill)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each column as text: ``column, rank, value, count, unique_count``.

    Ties go to the smaller value. Runs one job, and another if a long text is among the values.
    """
    columns = list(string_columns(df) if columns is None else columns)
    found = _first_texts(df, [present(df, c).cast("string") for c in columns], k) if columns else []
    rows = [(c, rank, *value) for c, values in zip(columns, found) for rank, value in enumerate(values, 1)]
    return df.sparkSession.createDataFrame(rows, "column string, rank bigint, value string, count bigint, unique_count bigint")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column (ties: the smallest); absent if all are null."""
    found: dict[str, object] = {}
    order = Window.partitionBy("slot").orderBy(F.desc("count"), F.asc("value"))
    for kind, group in _kinds(df, columns):
        if kind == "string":
            texts = _first_texts(df, [present(df, c).cast("string") for c in group], 1)
            found.update({c: values[0][0] for c, values in zip(group, texts) if values})
            continue
        ranked = _typed_counts(df, group, kind).withColumn("rank", F.row_number().over(order))
        for r in ranked.filter("rank = 1").select("slot", "value").collect():
            found[group[int(r["slot"])]] = r["value"]
    return found


def first_distinct(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, order_by: str | None = None
) -> dict[str, list[str]]:
    """First ``k`` different non-null values of each column as text, in ``order_by`` order (nulls first);
    where several rows share a place, the smaller text comes first.

    The head of the table settles most columns. The others take one aggregation, whatever ``k``,
    that finds the least place of each of their values.
    """
    columns = list(columns or data_columns(df))
    order = order_by or (ROW_ID if ROW_ID in df.columns else None)
    nested = nested_columns(df, columns)
    texts = {c: F.to_json(col(c)) if c in nested else present(df, c).cast("string") for c in columns}
    key = [] if order is None else [col(order).alias("_order")]
    reach = 20 * k
    head = first_rows(df.select(*[t.alias(f"c{i}") for i, t in enumerate(texts.values())], *key), reach, None if order is None else "_order")
    complete = len(head) < reach  # then it is the whole table
    if order is not None and not complete:  # other rows may share the last place
        head = [r for r in head if r["_order"] != head[-1]["_order"]]
    found = {}
    for i, c in enumerate(columns):
        values = [(r["_order"] if order else 0, r[i]) for r in head if r[i] is not None]
        if order is not None:
            values = [v for _, same in groupby(values, key=lambda v: v[0]) for v in sorted(same, key=lambda v: v[1].encode())]
        found[c] = list(dict.fromkeys(v for _, v in values))[:k]
    unfinished = [] if complete else [c for c in columns if len(found[c]) < k]
    if unfinished:
        place = F.monotonically_increasing_id() if order is None else F.struct(col(order).isNotNull().alias("given"), col(order).alias("order"))
        for batch in batches(unfinished):
            for c, values in zip(batch, _first_texts(df, [texts[c] for c in batch], k, place)):
                found[c] = [v[0] for v in values]
    return found


# --- Numeric statistics -----------------------------------------------------
@dataclass(frozen=True)
class NumericStats:
    column: str
    row_count: int
    null_count: int
    min: float | None
    max: float | None
    mean: float | None
    std: float | None
    q1: float | None
    median: float | None
    q3: float | None
    iqr: float | None
    whisker_low: float | None
    whisker_high: float | None
    outlier_count: int


NUMERIC_STATS_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("null_count", T.LongType()),
        *[
            T.StructField(n, T.DoubleType())
            for n in ("min", "max", "mean", "std", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high")
        ],
        T.StructField("outlier_count", T.LongType()),
    ]
)


def _number(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def outside(df: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    """Test for a value strictly outside the bounds; not true for null and NaN.

    Plain comparisons of the column with literals, so that a filter reaches the scan.
    """
    if low is None or high is None or math.isnan(low) or math.isnan(high):
        return F.lit(False)
    c = col(name)
    if integral_columns(df, [name]) and max(abs(low), abs(high)) < 2**62:
        return (c < F.lit(math.ceil(low)).cast("bigint")) | (c > F.lit(math.floor(high)).cast("bigint"))
    if floating_columns(df, [name]):  # NaN compares above infinity
        return (c < F.lit(low)) | ((c > F.lit(high)) & (c <= F.lit(float("inf"))))
    return (c.cast("double") < F.lit(low)) | (c.cast("double") > F.lit(high))


def iqr_bounds(quartiles: Sequence[float | None], k: float = IQR_FACTOR) -> tuple[float | None, float | None]:
    q1, q3 = quartiles[0], quartiles[-1]
    if q1 is None or q3 is None:
        return None, None
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def numeric_stats(
    df: DataFrame, columns: Sequence[str] | None = None, count_outliers: bool = True
) -> list[NumericStats]:
    """Moments, exact quartiles, whiskers and outlier count of each numeric column."""
    result = []
    for batch in batches(numeric_columns(df, columns)):
        if batch:
            result.extend(_numeric_batch(df, batch, count_outliers))
    return result


def _numeric_batch(df: DataFrame, columns: list[str], count_outliers: bool) -> list[NumericStats]:
    flat = [F.count(F.lit(1))]
    for c in columns:
        v = as_double(df, c)
        flat += [F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), near_quantiles(v, QUARTILES)]
    rows, *moments = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(flat)]).first()
    facts = {c: moments[6 * i : 6 * i + 5] for i, c in enumerate(columns)}
    near = {c: around(moments[6 * i + 5], QUARTILES) for i, c in enumerate(columns)}
    quartiles = exact_quantiles(df, columns, QUARTILES, {c: Bounds(*f[:3], near[c]) for c, f in facts.items()})
    limits = {c: iqr_bounds(quartiles[c]) for c in columns}
    outliers = [0] * len(columns)
    # Bounds that enclose the whole range need no count.
    tests = {c: outside(df, c, *limits[c]) for c in columns if _reaches_outside(facts[c], limits[c])}
    if count_outliers and tests:
        counted = df.agg(*[F.count_if(t).alias(f"a{i}") for i, t in enumerate(tests.values())]).first()
        outliers = [dict(zip(tests, counted)).get(c, 0) for c in columns]
    result = []
    for c, outlier_count in zip(columns, outliers):
        count, *spread = facts[c]
        q1, median, q3 = (_number(q) for q in quartiles[c])
        low, high = (_number(x) for x in limits[c])
        iqr = None if q1 is None else _number(q3 - q1)
        result.append(
            NumericStats(c, rows, rows - count, *map(_number, spread), q1, median, q3, iqr, low, high, outlier_count)
        )
    return result


def _reaches_outside(facts: Sequence, limits: tuple[float | None, float | None]) -> bool:
    low, high = limits
    return low is not None and (facts[1] < low or facts[2] > high)


def numeric_stats_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``numeric_stats`` as a DataFrame, one row per column."""
    rows = [tuple(vars(s).values()) for s in numeric_stats(df, columns)]
    return df.sparkSession.createDataFrame(rows, NUMERIC_STATS_SCHEMA)
