"""Vectors in blocks, and blocks of one table met with all blocks of another in bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, staged

#: Bytes of the vectors of a block, and blocks of either side that one group takes.
BLOCK_BYTES, GROUP = 2 << 20, 8


def whole_vector(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double; null if the vector is null or holds a null
    or non-finite component."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale)))


@dataclass(frozen=True)
class Block:
    """``vectors`` (rows by components, whole numbers as doubles) and the numbers that go with each row."""

    vectors: np.ndarray
    numbers: dict[str, np.ndarray]

    def scores(self, other: Block) -> np.ndarray:
        """Inner products of all rows with all of ``other``: exact 64-bit numbers, else OverflowError."""
        a, b = self.vectors, other.vectors
        largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if largest < 2.0**53:
            return (a @ b.T).astype(np.int64)
        whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
        return (whole[0] @ whole[1].T).astype(np.int64)


def blocks(rows: DataFrame, numbers: Sequence[str], most: int = 4096, split: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``part, dims, values`` and a binary column for each of ``numbers``, staged: at most ``most`` rows of
    ``rows`` (``vector`` of whole numbers, ``numbers`` long and not null) and ``BLOCK_BYTES`` in each block.

    A block holds vectors of one length. ``split``: rows that are close in this order share blocks;
    without it they are dealt by hash.
    """
    n_parts = parts or parts_for(rows.count(), most)
    dealt = rows.repartitionByRange(n_parts, *split) if split else rows.repartition(n_parts, F.xxhash64(*numbers))
    schema = "part int, dims int, values binary, " + ", ".join(f"{n} binary" for n in numbers)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def block(dims: int) -> pa.RecordBatch:
            vectors, keys = zip(*held.pop(dims))
            flat = np.array(vectors, "<f8").tobytes()
            columns = [np.array(k, "<i8").tobytes() for k in zip(*keys)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([dims], pa.int32()), *[pa.array([x], pa.binary()) for x in (flat, *columns)]],
                names=["part", "dims", "values", *numbers])

        for batch in batches:
            keys = zip(*[c.to_pylist() for c in batch.columns[1:]])
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy())
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for end, start, key in zip(ends.tolist(), [0, *ends[:-1].tolist()], keys):
                dims = end - start
                held.setdefault(dims, []).append((flat[start:end], key))
                if len(held[dims]) >= min(most, max(1, BLOCK_BYTES // (8 * max(dims, 1)))):
                    yield block(dims)
        for dims in list(held):
            yield block(dims)

    cells = [F.col("vector").cast("array<double>").alias("vector"), *[F.col(n).cast("long") for n in numbers]]
    return staged(dealt.select(*cells).mapInArrow(pack, schema))


def _unpacked(table: pa.Table, numbers: Sequence[str]) -> list[Block]:
    out = []
    for row in table.to_pylist():
        keys = {n: np.frombuffer(row[n], "<i8") for n in numbers}
        out.append(Block(np.frombuffer(row["values"], "<f8").reshape(-1, row["dims"]) if row["dims"] else np.zeros((len(keys[numbers[0]]), 0)), keys))
    return out


def meet(left: DataFrame, right: DataFrame, f: Callable[[list[Block], list[Block]], pa.Table], schema: str) -> DataFrame:
    """``f`` of every group of ``left`` blocks with every group of ``right`` blocks, equal lengths only.

    A group of a side is what about ``GROUP`` of its parts hold, so a block is sent once for every
    ``GROUP`` parts of the other side, and no task holds more than two such groups. Few parts make
    smaller groups, as many as the session has cores.
    """
    names = [[c for c in side.columns if c not in ("part", "dims", "values")] for side in (left, right)]
    held = [(side.agg(F.max("part")).first()[0] or 0) + 1 for side in (left, right)]
    cores = left.sparkSession.sparkContext.defaultParallelism
    size = GROUP
    while size > 1 and parts_for(held[0], size) * parts_for(held[1], size) < 2 * cores:
        size //= 2
    groups = [parts_for(n, size) for n in held]
    keys = ["lg", "rg", "dims"]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in groups]
    a = left.select(F.floor(F.col("part") / size).cast("int").alias("lg"), every[1].alias("rg"), "dims", "values", *names[0])
    b = right.select(F.floor(F.col("part") / size).cast("int").alias("rg"), every[0].alias("lg"), "dims", "values", *names[1])
    types = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in schema.split(", "))])

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        return f(_unpacked(x, names[0]), _unpacked(y, names[1])) if x.num_rows and y.num_rows else types.empty_table()

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(work, schema)
