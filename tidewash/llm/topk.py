"""Exact top-k search by inner product: tiled matrix products and merged top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, staged

#: Vectors of a shard and queries of a tile; one product holds SHARD x TILE scores.
SHARD, TILE = 4096, 512
#: Top lists that one merge takes.
FAN_IN = 16


def whole_numbers(vectors: DataFrame, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, vector``: each component x becomes floor(scale * x), x as double. Rows whose vector is
    null, or has null or non-finite components, are left out, and those without an identifier, which
    no result could name. Identifiers are whole numbers; texts of other things fail."""
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(x.isNotNull() & ~bad).withColumn("vector", F.transform(x, lambda v: F.floor(v * scale).cast("double")))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks: ``block, ids, dims, values``; vectors of one length each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, values = zip(*held.pop(dims))
            made += 1
            return pa.RecordBatch.from_pydict(
                {"block": [base + made], "ids": [np.array(ids, "<i8").tobytes()], "dims": [dims], "values": [np.stack(values).astype("<f8").tobytes() if dims else b""]},
                schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("dims", pa.int64()), ("values", pa.binary())]),
            )

        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(1).value_lengths().to_numpy())
            for i, (n, end) in enumerate(zip(batch.column(0).to_pylist(), ends)):
                v = flat[(ends[i - 1] if i else 0) : end]
                held.setdefault(len(v), []).append((n, v))
                if len(held[len(v)]) == size:
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(pack, "block long, ids binary, dims long, values binary")


def _products(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, shard``: the k best of each query in each shard."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids, dims = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8"), row["dims"]
                q, v = np.frombuffer(row["q_values"], "<f8").reshape(len(q_ids), dims), np.frombuffer(row["values"], "<f8").reshape(len(ids), dims)
                if dims and float(np.abs(q).max()) * float(np.abs(v).max()) * dims < 2.0**53:
                    scores = (q @ v.T).astype(np.int64)  # whole numbers below 2**53: exact in doubles
                else:
                    scores = (q.astype(object) @ v.astype(object).T) if dims else np.zeros((len(q), len(v)), np.int64)
                    scores = scores.astype(np.int64)
                out = []
                for i, own in enumerate(q_ids):
                    line, others = scores[i], np.flatnonzero(ids != own)
                    if len(others) > k:  # all that tie with the k-th stay for the sort by id
                        kth = np.partition(line[others], len(others) - k)[len(others) - k]
                        others = others[line[others] >= kth]
                    best = others[np.lexsort((ids[others], -line[others]))][:k]
                    out.append((np.full(len(best), own), ids[best], line[best]))
                a, b, c = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(np.full(len(a), row["shard"], np.int64))], names=["query_id", "vec_id", "score", "shard"])

    return pairs.mapInArrow(multiply, "query_id long, vec_id long, score long, shard long")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k vectors of highest inner product.

    Both sides are ``id, vector`` with whole-number components (:func:`whole_numbers`). Vectors
    are packed into shards and queries into tiles; every tile meets every shard in one matrix
    product (shards are sent once per group of tiles, never single rows), each product gives the
    k best per query, and lists merge in rounds of ``FAN_IN`` shards until one is left. Each task
    numbers the shards it packs; no row with vectors goes through a window.

    Ties go to the smaller identifier; a query's own identifier is no candidate, other rows with
    an equal vector are. Rows that repeat an identifier are candidates of their own, and repeated
    queries are answered once, by
    the least of their vectors. Vectors of other lengths than the query's are no candidates.
    Fewer than k candidates give a shorter list, none give no rows. Scores outside 64 bits fail.
    """
    session = queries.sparkSession
    count = vectors.count()
    n_shards = parts_for(count, shard)
    shards = staged(_blocks(vectors.repartition(n_shards, F.xxhash64("id")), shard))
    # The upper half of a block's number is its part, the lower half counts the part's blocks.
    place = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) - 1
    shards = shards.withColumn("shard", F.pmod(place, F.lit(n_shards)))
    asked = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    tiles = staged(_blocks(asked.repartition(parts_for(asked.count(), tile), F.xxhash64("id")), tile).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("dims"), F.col("values").alias("q_values")))
    # Every tile goes to every group of shards once; a group is what one task reads.
    groups = min(n_shards, 4 * session.sparkContext.defaultParallelism)
    sent = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = sent.join(shards.withColumn("group", (F.col("shard") % groups).cast("int")), ["group", "dims"])
    best = _products(pairs.select("q_ids", "q_values", "ids", "values", "dims", "shard"), k)
    by_score = [F.col("score").desc(), "vec_id"]
    left = n_shards
    while left > 1:
        best = best.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*by_score)))
        best, left = best.where(F.col("rank") <= k).drop("rank"), parts_for(left, FAN_IN)
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score)).cast("int")
    return best.select("query_id", ranks.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
