"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: White space of the corpus operators: space and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that ``staged`` wrote and nothing has deleted yet.
_written: list[str] = []


#: Rows that go to a Python worker at a time, at most: both sides hold them, and whole documents are long.
BATCH, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> str:
    """Bounds the session's Arrow batches; returns what was set before."""
    before = spark.conf.get(BATCH)
    if not 0 < int(before) <= ROWS_PER_BATCH:
        spark.conf.set(BATCH, ROWS_PER_BATCH)
    return before


def staged(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage, and a lost
    executor costs no recomputation."""
    path = shared_folder(df.sparkSession)
    before = small_batches(df.sparkSession)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(BATCH, before)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables whose rows nothing will read again: all that is made of them is staged."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for known in [x for x in _written if path.endswith(x.rsplit("/", 1)[1])]:
                _delete(df.sparkSession, known)


class Leftovers:
    """Deletes what earlier calls have staged, but for folders that a table still reads."""

    def __init__(self) -> None:
        self.held: list[str] = []

    def begin(self, docs: DataFrame) -> None:
        """Call before new work on ``docs``, which holds the result of the work before."""
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()} if self.held else set()
        for path in self.held:
            if path in _written and path.rsplit("/", 1)[1] not in read:
                _delete(docs.sparkSession, path)
        self.before = len(_written)

    def end(self) -> None:
        """Call when the work's own tables are staged; the next ``begin`` deletes them."""
        self.held = _written[self.before :]


def numbered(df: DataFrame) -> DataFrame:
    """``doc`` (the whole row) with ``file`` and ``row``, two numbers that stay the same whenever the
    rows are read again: the file's hash and the row's place in it. Rows that don't come
    straight from files are staged first."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        df = staged(df)
    place = df.metadataColumn("_metadata")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))


def give_back() -> None:
    """Call at the end of a worker's task: freed memory goes back to the system, as the worker stays for
    other steps. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20, field: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column (or that field of a struct column) holds about ``most_bytes``, or one row."""
    start, held = 0, 0
    texts = batch.column(column) if field is None else batch.column(column).field(field)
    lengths = pc.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def running_sum(df: DataFrame, order: list[str], value: str, out: str, parts: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all earlier rows and the row itself, in ``order``.

    The rows are range-sorted; sums of whole parts (one row per part) give each part its
    start, so no task holds more than its range. ``order`` must be free of ties, or the
    order within a tie is arbitrary.
    """
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each part, and parts are bounded in number by the caller: small enough to broadcast.
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(out, F.sum(value).over(inside) + F.col("_start")).drop("_part", "_start")
    )
