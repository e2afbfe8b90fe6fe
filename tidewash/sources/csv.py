"""CSV input as text columns: encodings, quoted newlines, header repair, missing cells, row numbers.

Files are scanned as lines, which Spark splits among tasks. Whether a line starts inside a quoted
cell depends on all lines before it, so each line is taken as a map from "starts outside" and
"starts inside" to how it ends. The maps of a block's lines make the block's map, those of blocks
give the state at the start of every block, and each block then finds its own records.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ROW_ID
from ..functions import blank_to_null, col, null_tokens
from ..functions.text import READER_NA_TOKENS
from ..operators.columns import data_columns

# --- Fixed values -----------------------------------------------------------
DEFAULT_ENCODINGS = ("utf-8", "latin-1")
# Encoding names as the JVM spells them.
JVM_NAMES = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
# Lines whose order is found together, by one task.
BLOCK_LINES = 1 << 16
# ----------------------------------------------------------------------------


# Encodings in which lines and quotes can be found before the text is decoded.
SPLITTABLE = ("utf-8", "latin-1")
OPTIONS = {
    "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
TOO_LONG = "a row has more cells than the header"
# Behind every line.
_NEVER = (1 << 63) - 1
MOVED = "the files were split differently than when they were inspected; read them again"

# Parts of a line, all possessive, so each pattern passes a line once: a quoted text up to its last
# character, fields with the comma behind them, and a quoted cell that the line leaves open.
_QUOTED = '[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_OPEN = f'"{_QUOTED}$'
ENDS_INSIDE = (f"(?s)^{_FIELDS}{_OPEN}", f'(?s)^{_QUOTED}(?:$|"[^,]*+,{_FIELDS}{_OPEN})')


class LoadError(ValueError):
    """The input cannot be used as a table."""


@dataclass(frozen=True)
class CsvTable:
    """A scanned CSV: all columns are text, plus ``_row_id`` if asked for."""

    df: DataFrame
    encodings: tuple[str, ...]
    kept: tuple[DataFrame, ...] = ()

    @property
    def encoding(self) -> str:
        """The encoding used; the last one tried if files differ."""
        return self.encodings[-1]

    def metadata(self) -> DataFrame:
        """``rows, columns, encoding`` in one row."""
        count = self.df.agg(F.count(F.lit(1)).alias("rows"))
        columns = F.lit(len(data_columns(self.df))).cast("bigint")
        return count.select("rows", columns.alias("columns"), F.lit(self.encoding).alias("encoding"))

    def release(self) -> None:
        """Lets go of what the inspection found, when the rows are no longer needed."""
        for df in self.kept:
            df.unpersist()


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, block, place, value``: every line with its raw bytes. ``place`` grows along a block, which
    is what one task reads of a file, in pieces of ``BLOCK_LINES`` at most. A line ends at a line feed; a carriage
    return before it is kept."""
    lines = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"), "value")
    return lines.select("file", F.struct("at", F.expr(f"place DIV {BLOCK_LINES}").alias("piece")).alias("block"), "place", "value")


def _ends_inside() -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell if it starts outside of one, and if it starts inside."""
    quoted = F.contains("value", F.lit('"'))
    return tuple(F.when(quoted, F.col("value").rlike(p)).otherwise(bool(i)) for i, p in enumerate(ENDS_INSIDE))


def _blank() -> Column:
    return ~F.col("value").rlike(r"[^\x00-\x20]")


def _after(out0: Column, out1: Column, window) -> tuple[Column, Column]:
    """States after each row of the window for either state before its first row. The last row whose
    state does not depend on the one before it settles the state; later ones may only turn it around."""
    turns = F.sum((out0 & ~out1).cast("int")).over(window)
    fixed = F.last(F.when(out0 == out1, F.struct(out0.alias("state"), turns.alias("turns"))), ignorenulls=True).over(window)
    odd = (turns - F.coalesce(fixed["turns"], F.lit(0))) % 2 == 1
    return tuple(F.coalesce(fixed["state"], F.lit(s)) != odd for s in (False, True))


def _inspected(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per file and block: first place and number of its first line, and of the file whether all
    is UTF-8, whether a cell is open at some line's end, and its header line with that one's number.

    Lines are numbered through all files, in the order of their paths. The second table is what the first is made of,
    kept as well.
    """
    opens, _ = _ends_inside()
    # Whole lines stay out of this aggregation, so that it needs no sort.
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("place").alias("first_place"), F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8"),
        F.bool_or(opens).alias("opens"), F.min(F.when(~_blank(), F.col("place"))).alias("first_text"))
    # One row for each block, so these windows stay small.
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("file")
    blocks = blocks.withColumn("start", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    blocks = blocks.withColumn("text_line", F.col("start") + F.col("first_text") - F.col("first_place"))
    blocks = blocks.select(
        "file", "block", "first_place", "start", F.bool_and("valid_utf8").over(file).alias("valid_utf8"), F.bool_or("opens").over(file).alias("opens"),
        F.min("text_line").over(file).alias("header_line"), "text_line", "first_text")
    # The name keeps Spark from taking an earlier read of the same paths for this one.
    blocks = blocks.withColumn("read", F.lit(uuid.uuid4().hex)).persist()
    places = blocks.where("text_line = header_line").select("file", "block", F.col("first_text").alias("place"))  # one for each file
    headers = lines.join(F.broadcast(places), ["file", "block", "place"]).select("file", F.col("value").cast("binary").alias("header"))
    return blocks.drop("text_line", "first_text").join(F.broadcast(headers), "file", "left").persist(), blocks


def _quote_states(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``file, block, home, closed, ends_inside``: for a block that starts inside a quoted cell, the number of the first
    line of the block in which that cell's record opens, and of the line that ends the cell in this block; and the
    state behind the block. Only lines that can change a state are looked at, each as a few numbers."""
    out0, out1 = _ends_inside()
    marks = lines.select("file", "block", "place", out0.alias("out0"), out1.alias("out1")).where(F.col("out0") | ~F.col("out1"))
    run = Window.partitionBy("file", "block").orderBy("place")
    after = _after(F.col("out0"), F.col("out1"), run.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.select("file", "block", "place", after[0].alias("a0"), after[1].alias("a1"))
    # One row for each block from here on.
    maps = marks.groupBy("file", "block").agg(*[F.max_by(f"a{s}", "place").alias(f"out{s}") for s in (0, 1)], F.min(F.when(~F.col("a1"), F.col("place"))).alias("closed"))
    maps = blocks.select("file", "block", "first_place", "start").join(maps, ["file", "block"], "left")
    maps = maps.fillna(False, "out0").fillna(True, "out1")
    run = Window.partitionBy("file").orderBy("block")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("ends_inside", _after(F.col("out0"), F.col("out1"), upto)[0])
    maps = maps.withColumn("inside", F.lag("ends_inside", 1, False).over(run))
    # The record that is open behind a block opened in it, unless one cell fills the whole block.
    opening = F.when(F.col("ends_inside") & ~(F.col("inside") & F.col("closed").isNull()), F.col("start"))
    maps = maps.withColumn("home", F.last(opening, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    closed = F.coalesce(F.col("closed") - F.col("first_place") + F.col("start"), F.lit(_NEVER))
    return maps.select("file", "block", F.when(F.col("inside"), F.col("home")).alias("home"), F.when(F.col("inside"), closed).alias("closed"), "ends_inside")


def _spanning_records(lines: DataFrame) -> DataFrame:
    """``line, kind, value`` of the records of files with open cells. Lines are sorted within their blocks
    to find the state of each, and those that belong together are put together there: the lines that end
    another block's last record go to that block, so whole lines are shuffled once."""
    home = F.when(F.col("line") <= F.col("closed"), F.col("home")).otherwise(F.col("start"))
    run = Window.partitionBy("start").orderBy("line")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    out0, out1 = _ends_inside()
    states = lines.select(home.alias("start"), "line", "kind", "value", out0.alias("out0"), out1.alias("out1"))
    states = states.withColumn("a", _after(F.col("out0"), F.col("out1"), upto)[0])
    states = states.withColumn("b", F.lag("a", 1, False).over(run))
    states = states.withColumn("record", F.last(F.when(~F.col("b"), F.col("line")), ignorenulls=True).over(upto))
    parts = states.where(F.col("a") | F.col("b") | ~_blank()).groupBy("start", "record").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return parts.select(F.col("record").alias("line"), "kind", whole.alias("value"))


@dataclass(frozen=True)
class _Kind:
    """Files with the same encoding, header and way of reading."""

    encoding: str
    names: tuple[str, ...]
    file: str  # one of them
    lines: bool  # line feeds end its lines
    split: bool


def _kinds(blocks: DataFrame, tried: Sequence[str], path) -> dict[tuple, _Kind]:
    """The kinds of files by ``valid_utf8`` and ``header``; files without any text have none."""
    text = F.col("header").cast("string")
    found = blocks.groupBy("valid_utf8", "header", text.rlike(r"\r(?s:.)").alias("returns"), text.rlike(ENDS_INSIDE[0]).alias("open")).agg(F.min("file").alias("file"), F.count_distinct("file").alias("files")).orderBy("file").collect()
    if not found:
        raise LoadError(f"Only empty files at {path}")
    kinds: dict[tuple, _Kind] = {}
    for r in found:
        fitting = [e for e in tried if r["valid_utf8"] or e != "utf-8"]
        if not fitting:
            raise LoadError(f"No CSV in {', '.join(tried)}: there are bytes that are no text in {r['file']}{_more(r['files'])}")
        if r["header"] is not None:
            lines = fitting[0] in SPLITTABLE and not r["returns"]
            split = lines and not r["open"]
            # Other headers need Spark's reader, which knows their encoding and line ends.
            names = unique_header(next(csv.reader([bytes(r["header"]).decode(fitting[0]).removesuffix("\r")]))) if split else ()
            kinds[r["valid_utf8"], bytes(r["header"])] = _Kind(fitting[0], names, r["file"], lines, split)
    if not kinds:
        raise LoadError(f"No header at {path}")
    return kinds


def unique_header(names: Sequence[str | None]) -> tuple[str, ...]:
    """Header names with ``.1``, ``.2``, … after repeats and ``Unnamed: n`` for missing ones."""
    result: list[str] = []
    seen: dict[str, int] = {}
    for position, name in enumerate(names):
        name = f"Unnamed: {position}" if name is None or name == "" else name.removeprefix("﻿")
        after = name
        while after in seen:
            seen[name] += 1
            after = f"{name}.{seen[name]}"
        seen.setdefault(after, 0)
        result.append(after)
    return tuple(result)


def _plain_path(uri: str) -> str:
    """A file's URI as the path that reads exactly this file (glob characters escaped)."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(uri))


def _more(files: int) -> str:
    return f" and {files - 1} more files" if files > 1 else ""


def _whole_files(spark: SparkSession, blocks: DataFrame, kinds: Sequence[_Kind]) -> list[tuple[_Kind, DataFrame]]:
    """Kinds (with their names) and ``_row_id, cells`` of files that only Spark's reader can read, each in
    one task: other encodings, carriage returns alone as line ends, headers over several lines."""
    out = []
    for i, kind in enumerate(kinds):
        if not kind.split:
            files = [r["file"] for r in blocks.where(F.col("kind") == i).select("file").distinct().collect()]
            options = {**OPTIONS, "encoding": JVM_NAMES.get(kind.encoding, kind.encoding)}
            paths = [_plain_path(f) for f in files]
            names = unique_header(list(spark.read.options(**options).csv(paths).head() or ()))
            rows = spark.read.schema(_schema(len(names))).options(**options, header=True, enforceSchema=True).csv(paths)
            rows = rows.select((F.monotonically_increasing_id() - F.lit(1 << 62)).alias("line"), F.lit(i).alias("kind"), F.struct(*rows.columns).alias("cells"))
            out.append((replace(kind, names=names), rows))
    return out


def _schema(n: int) -> str:
    """Cells c0, c1, …, and one that holds what a row has beyond the header."""
    return ", ".join(f"c{i} string" for i in range(n + 1))


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encodings: Sequence[str] | None = None,
    multi_line: bool | None = None,
    na_tokens: Sequence[str] = READER_NA_TOKENS,
    row_id: bool = True,
) -> CsvTable:
    """Scan CSV files with a header row into text columns.

    Two passes over the lines find each file's header line, the first of ``encodings`` that fits it,
    and whether cells hold line breaks; files of either kind are split among tasks.
    ``multi_line=False`` takes every line for a record. Columns of several files meet by name; headers
    with other names are an error. Missing tokens and blank cells become null. Repeated header names
    get ``.1``, ``.2``, …; unnamed ones ``Unnamed: n``.

    ``_row_id`` is the number of the record's first line, counted through all files in the order of
    their paths, so it is the order of the input whatever the number of tasks. (Files that cannot
    be split, see :func:`_whole_files`, come first, in scan order.) Lines are numbered by blocks as
    the inspection found them: if the session's cores or file settings change so much that Spark
    cuts the files elsewhere, the read stops and has to be repeated. ``release`` lets go of the
    inspection's result, a row for each block.
    """
    tried = tuple(encodings or DEFAULT_ENCODINGS)
    try:
        lines = _lines(spark, [path] if isinstance(path, str) else path)
        blocks, counted = _inspected(lines)
        by_header = _kinds(blocks, tried, path)
    except AnalysisException as e:
        raise LoadError(f"There is nothing to read at {path}") from e
    kinds = list(by_header.values())
    number = F.lit(None).cast("int")
    for i, (valid, header) in enumerate(by_header):
        number = F.when((F.col("valid_utf8") == valid) & (F.col("header") == header), i).otherwise(number)
    known = blocks.withColumn("kind", number)
    whole = dict(zip([i for i, k in enumerate(kinds) if not k.split], _whole_files(spark, known, kinds)))
    kinds = [whole[i][0] if i in whole else k for i, k in enumerate(kinds)]
    columns = kinds[0].names
    for kind in kinds:
        if not kind.names:
            raise LoadError(f"No header in {kind.file}")
        if sorted(kind.names) != sorted(columns):
            raise LoadError(f"{kinds[0].file} has the columns {', '.join(columns)}, another file, {kind.file}, has {', '.join(kind.names)}")

    split = [i for i, k in enumerate(kinds) if k.split]
    known = known.withColumn("opens", F.coalesce(F.col("opens") & F.col("kind").isin([i for i, k in enumerate(kinds) if k.lines] or [-1]), F.lit(False)))
    kept, spanning = [blocks], multi_line is not False and not known.where("opens").isEmpty()
    if spanning:
        states = _quote_states(lines, known.where("opens")).persist()
        kept.append(states)
        file, count = states.groupBy("file").agg(F.max_by("ends_inside", "block").alias("open")).where("open").agg(F.min("file"), F.count(F.lit(1))).first()
        if count:
            raise LoadError(f"No CSV in {', '.join(tried)}: a quoted cell never ends in {file}{_more(count)}")
        known = known.join(states.drop("ends_inside"), ["file", "block"], "left")
    # Files that are read whole have no part in the lines.
    known = known.withColumn("kind", F.when(F.col("kind").isin(split or [-1]), F.col("kind")))
    known = known.withColumn("opens", F.col("opens") & F.lit(spanning))
    plain = not spanning or not known.where("kind IS NOT NULL AND NOT opens").isEmpty()

    def table(by_lines: bool = False) -> DataFrame:
        rows = [r for _, r in whole.values()]
        if split:
            some = lines.join(known.drop("valid_utf8", "header"), ["file", "block"], "left")
            some = some.withColumn("line", F.col("start") + F.col("place") - F.col("first_place"))
            # Conditions that hold for nulls or are over both sides, so that lines of an unknown block reach the error.
            wanted = F.col("kind").isNotNull() & (F.col("start") + F.col("place") - F.col("first_place") > F.col("header_line"))
            some = some.where(F.when(F.col("start").isNull() & F.col("place").isNotNull(), F.raise_error(F.lit(MOVED)).cast("boolean")).otherwise(wanted))
            records = []
            if plain or by_lines:
                alone = F.lit(True) if by_lines else ~F.coalesce("opens", F.lit(False))
                records.append(some.where(alone & ~_blank()).select("line", "kind", "value"))
            if spanning and not by_lines:
                records.append(_spanning_records(some.where(F.coalesce("opens", F.lit(True)))))
            records = reduce(DataFrame.union, records)
            latin = F.col("kind").isin([i for i in split if kinds[i].encoding == "latin-1"] or [-1])
            value = F.when(latin, F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
            rows.append(records.select("line", "kind", F.from_csv(_without_return(value), _schema(len(columns)), OPTIONS).alias("cells")))
        return _cells(reduce(DataFrame.union, rows), kinds, columns, na_tokens, row_id, any_length=by_lines)

    df = table()
    try:
        # Records with open cells are found by a sort of whole blocks. A value in a line by itself is one
        # in its record, so that is tried first.
        if not spanning or not _usable(table(by_lines=True)):
            _reject_unusable(df, path)
    except SparkRuntimeException as e:
        raise LoadError(f"No CSV in {', '.join(tried)}: {MOVED if MOVED in str(e) else TOO_LONG}") from e
    return CsvTable(df, tuple(dict.fromkeys(k.encoding for k in sorted(kinds, key=lambda k: tried.index(k.encoding)))), (*kept, counted))


def _without_return(value: Column) -> Column:
    """The record without a carriage return at its end."""
    return F.when(F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)


def _cells(rows: DataFrame, kinds: Sequence[_Kind], columns: Sequence[str], na_tokens: Sequence[str], row_id: bool, any_length: bool) -> DataFrame:
    """The columns by name, from ``line, kind, cells``; kinds may have them in other orders."""
    orders: dict[tuple[str, ...], list[int]] = {}
    for i, k in enumerate(kinds):
        orders.setdefault(k.names, []).append(i)
    # A row longer than the header stops the read, rather than losing its last cells.
    extra = F.col("cells")[f"c{len(columns)}"]
    if not any_length:
        rows = rows.where(F.when(extra.isNull(), True).otherwise(F.raise_error(F.lit(TOO_LONG)).cast("boolean")))
    cells = []
    for c in columns:
        cell = None
        for names, numbers in orders.items():
            this = F.col("cells")[f"c{names.index(c)}"]
            cell = this if cell is None else F.when(F.col("kind").isin(numbers), this).otherwise(cell)
        cells.append(blank_to_null(null_tokens(cell, na_tokens)).alias(c))
    return rows.select(*([F.col("line").alias(ROW_ID)] if row_id else []), *cells)


def _usable(df: DataFrame) -> bool:
    """Whether some cell has a value; stops at the first one."""
    return not df.filter(reduce(lambda a, b: a | b, [col(c).isNotNull() for c in data_columns(df)])).isEmpty()


def _reject_unusable(df: DataFrame, path) -> None:
    if not _usable(df):
        if df.isEmpty():
            raise LoadError(f"A header but no rows at {path}")
        raise LoadError(f"Not one cell with a value at {path}")
