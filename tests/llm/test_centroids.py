import hashlib

import numpy as np
import pytest

from tidewash.llm import centroids
from tidewash.llm.centroids import cluster_vectors, hadamard, nearest


def brute(rows, clusters, rounds, scale=256):
    """Plain rounds in Python's unbounded numbers: id -> (cluster, distance), and the centroids."""
    vectors = [(i, [int(np.floor(scale * float(np.float64(x)))) for x in v]) for i, v in rows]
    middle = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), k, v) for k, (i, v) in enumerate(vectors))][:clusters]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle)) for _, v in vectors]

    for _ in range(rounds):
        found = assign()
        for n in range(len(middle)):
            mine = [v for (_, v), (_, c) in zip(vectors, found) if c == n]
            if mine:
                middle[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return {i: (c, d) for (i, _), (d, c) in zip(vectors, assign())}, middle


def test_transform_keeps_distances_and_orders_by_changes_of_sign():
    rng = np.random.default_rng(1)
    v = rng.integers(-500, 500, (20, 64))
    h = hadamard(v)
    assert (((h[:10] - h[10:]) ** 2).sum(axis=1) == 64 * ((v[:10] - v[10:]) ** 2).sum(axis=1)).all()
    basis = hadamard(np.eye(8, dtype=np.int64))
    assert [int((np.diff(basis[:, i]) != 0).sum()) for i in range(8)] == list(range(8))


@pytest.mark.parametrize("large", [1, 2**40])
def test_search_is_exact_with_ties_to_the_smaller_number(large):
    rng = np.random.default_rng(2)
    v, c = rng.integers(-2, 3, (300, 6)) * large, rng.integers(-2, 3, (9, 6)) * large
    apart = ((v[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    best, distance = nearest(v, c)
    assert best.tolist() == [row.tolist().index(min(row)) for row in apart] and distance.tolist() == apart.min(axis=1).tolist()


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) + 3 * (i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want, middle = brute(rows, 7, 5)
    got = cluster_vectors(df, clusters=7, dims=8).collect()
    assert {r.id: (r.cluster, r.distance) for r in got} == want
    for r in got:
        mine = [d for c, d in want.values() if c == r.cluster]
        assert r.cluster_inertia == sum(mine) and r.inertia == sum(d for _, d in want.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [0.5, 2.0], 1), (None, [9.0, 9.0], 0), (2, None, 0), (3, [], 0), (4, [1.0], 0), (5, [nan, 1.0], 0), (6, [-inf, 1.0], 0), (7, [None, 1.0], 0), (8, [-0.001, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").withColumn("_metadata", df_null())
    got = sorted(cluster_vectors(df, clusters=40, dims=2).collect(), key=lambda r: (r.id is None, r.id or 0, r.distance))
    assert [r.id for r in got] == [1, 1, 1, 8, None] and got[0].distance == 0
    assert len({r.centroid_sha256 for r in got}) == len({r.cluster for r in got}) == 4
    assert cluster_vectors(df.limit(0)).count() == 0
    assert cluster_vectors(df.where("vec_id = 2"), dims=2).collect() == []


def df_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_jobs_do_not_grow_with_rows(spark, jobs):
    def run(n):
        rows = spark.range(n).selectExpr("id AS vec_id", "transform(sequence(1, 4), x -> sin(id * x)) AS embedding")
        return jobs(lambda: cluster_vectors(rows, clusters=5, dims=4).collect())

    assert run(50) == run(5000)
    assert centroids.SEARCHED < 5000
