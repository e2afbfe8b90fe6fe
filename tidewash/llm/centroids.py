"""Centroid clustering with a progressive search over Walsh-Hadamard coefficients, all in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import whole_vector
from .common import staged

#: Vectors searched at a time, and coefficients known after each step of the search.
SEARCHED, FIRST = 1024, 4


def hadamard(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, coarse coefficients (few changes of sign) first. Squared
    distances grow by the number of coefficients exactly. Lengths are padded to a power of two."""
    n, dims = vectors.shape
    size = 1 << max(dims - 1, 0).bit_length()
    out = np.zeros((n, size), vectors.dtype)
    out[:, :dims] = vectors
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    natural = sum((((gray >> i) & 1) << (bits - 1 - i) for i in range(bits)), np.zeros(size, np.int64))
    return out[:, natural]


def _exact(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers if no sum of the search can leave them, else as unbounded ones."""
    dims = max(centroids.shape[1], 1)
    largest = max((abs(int(f(x))) for x in (vectors, centroids) if x.size for f in (np.min, np.max)), default=0)
    kind = np.int64 if (4 * dims * largest) ** 2 * 2 * dims < 2**63 else object
    return vectors.astype(kind), centroids.astype(kind)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ties go to the smaller number.

    Squared differences of coefficients add up from coarse to fine, so a sum only grows. After each
    step the most promising centroid is finished and gives a bound; centroids strictly above it
    go, the others are carried on to the last coefficient.
    """
    vectors, centroids = _exact(vectors, centroids)
    v, c = hadamard(vectors), hadamard(centroids)
    size, best, distance = c.shape[1], np.zeros(len(v), np.int64), np.zeros(len(v), v.dtype)
    for at in range(0, len(v), SEARCHED):
        some = v[at : at + SEARCHED]
        row, number = (x.ravel() for x in np.indices((len(some), len(c))))
        total, done, bound = np.zeros(len(row), v.dtype), 0, None
        while done < size:
            upto = min(size, max(FIRST, 2 * done))
            apart = some[row, done:upto] - c[number, done:upto]
            total, done = total + (apart * apart).sum(axis=1), upto
            order = np.lexsort((number, total, row)) if total.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], total[i], number[i])), np.int64)
            lead = order[np.unique(row[order], return_index=True)[1]]  # one for each vector, in order
            if done < size:
                apart = some[:, done:] - c[number[lead], done:]
                full = total[lead] + (apart * apart).sum(axis=1)
                bound = full if bound is None else np.minimum(bound, full)
                kept = total <= bound[row]
                row, number, total = row[kept], number[kept], total[kept]
        best[at : at + SEARCHED], distance[at : at + SEARCHED] = number[lead], total[lead] // size
    return best, distance


def _matrix(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of each cluster. A task sends one row for each cluster and component."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = [0] * k, np.zeros((k, dims), object)
        for batch in batches:
            found = _matrix(batch, 1, dims)
            cluster, _ = nearest(found, centroids)
            found, _ = _exact(found, centroids)
            for c in np.unique(cluster).tolist():
                mine = found[cluster == c]
                rows[c] += len(mine)
                sums[c] += mine.sum(axis=0).astype(object)
        held = [c for c in range(k) if rows[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims), pa.int32()), pa.array(list(range(dims)) * len(held), pa.int32()),
             pa.array([rows[c] for c in held for _ in range(dims)], pa.int64()), pa.array([Decimal(int(x)) for c in held for x in sums[c]], pa.decimal128(38, 0))],
            names=["cluster", "place", "n", "total"])

    parts = vectors.mapInArrow(add, "cluster int, place int, n long, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    # At most one row for each centroid and component.
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cluster", "place").collect():
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def cluster_vectors(rows: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector kept.

    Kept are vectors of ``dims`` components, none null or non-finite; each component x becomes
    floor(scale * x). Centroids start as the kept vectors with the smallest SHA-256 of ``seed`` and the
    identifier in decimal; then ``rounds`` rounds of assignment and of means rounded down, and a last
    assignment. Empty clusters keep their centroid. A round is one pass over staged vectors;
    only sums of clusters reach the driver.

    Fewer vectors than ``clusters`` make fewer clusters, none give no rows. Repeated identifiers
    keep a row each; those of equal hash start in order of their vectors. A null identifier starts
    last and is kept. Numbers beyond 64 bits are cut to them by the rounding; a distance or
    inertia beyond them fails.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    kept = rows.select(F.col(id_column).alias("id"), whole_vector(F.col(vector_column), scale).alias("vector")).where(F.size("vector") == dims)
    kept = staged(kept)
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = kept.select(hashed.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(clusters).collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        for c, (n, total) in _sums(kept, centroids).items():
            centroids[c] = [x // n for x in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_matrix(batch, 1, dims), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], names=["id", "cluster", "distance"])

    found = staged(kept.mapInArrow(assign, f"id {kind}, cluster int, distance long"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    names = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # One row for each centroid.
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(names), "cluster")
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return found.join(F.broadcast(sums), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
