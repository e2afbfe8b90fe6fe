"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

#: Runs that one merge takes; the digest space is cut in as many slices each round.
FAN_IN = 16


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, digest`` (SHA-256 of the text in UTF-8, A-Z lower-cased; null counts as empty),
    ``bytes`` and ``check`` (an unrelated 64-bit hash) of each row. Texts are read whole."""
    kind = docs.schema[id_column].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [b"" if t is None else t.lower() for t in part.column(1).to_pylist()]  # bytes.lower(): A-Z only
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(map(len, texts), pa.int64()),
                     pa.array([xxhash.xxh64_intdigest(t) - 2**63 for t in texts], pa.int64())],
                    names=["id", "digest", "bytes", "check"],
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(digest, f"id {kind}, digest binary, bytes long, check long")


def _merged(runs: DataFrame, largest: bool) -> DataFrame:
    """Each part sorted by digest, equal texts in one row. Rows stream through: only the last
    row of a batch waits for the next batch."""
    names, how = ["digest", "bytes", "check", "run"], "max" if largest else "min"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.table(batch.columns, names=batch.schema.names)  # every column nullable
            rows = pa.concat_tables([held, rows]) if held else rows
            rows = rows.group_by(names, use_threads=False).aggregate([("keep", how), ("copies", "sum")])
            rows = rows.rename_columns([*names, "keep", "copies"]).select(batch.schema.names)
            yield from rows.slice(0, rows.num_rows - 1).to_batches()
            held = rows.slice(rows.num_rows - 1)
        if held:
            yield from held.to_batches()

    ordered = runs.select("run", "digest", "bytes", "check", "keep", "copies").sortWithinPartitions("digest", "bytes", "check", "run")
    return ordered.mapInArrow(merge, ordered.schema)


def merge_runs(runs: DataFrame, parts: int, fan_in: int = FAN_IN, largest: bool = False) -> DataFrame:
    """One row per text: ``digest, bytes, check, keep, copies`` from parts of the same columns.

    Every part becomes a sorted run. In round r, runs whose numbers (base ``fan_in``) agree
    beyond the last r digits exchange: each takes over one more digit of the digest and merges
    what it is sent in digest order, keeping the smallest identifier (or the largest) and the
    number of copies. A text with a third of all rows is one row per run before anything is
    sent, and each of the last owners holds one slice of the digests. Rows merge only where
    length and second hash agree as well; a null identifier loses to all others.
    """
    rounds = 0
    while fan_in**rounds < parts:
        rounds += 1
    merged = _merged(runs.withColumn("run", F.spark_partition_id() % parts), largest)
    digit = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    for r in range(1, rounds + 1):
        sent = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        merged = _merged(sent.repartition(parts, F.col("run"), digit % fan_in**r), largest)
    return merged.drop("run")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", largest: bool = False) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, digest``.

    Equal texts (after lower-casing A-Z only, null as empty) form a group; its row with the
    smallest identifier stays, or with the largest. Rows that repeat an identifier each count;
    if the identifier that stays is repeated within its group, all of those rows are marked
    kept. A null identifier stays only in a group without any other. Empty tables give no rows.
    """
    rows = staged(digests(docs, id_column, text_column))
    runs = rows.select("digest", "bytes", "check", F.col("id").alias("keep"), F.lit(1).cast("long").alias("copies"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = merge_runs(runs, parts, largest=largest)
    return rows.join(merged, ["digest", "bytes", "check"]).select(
        "id", F.col("keep").alias("keep_id"), F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), "digest",
    )
