import numpy as np

from tidewash.llm import topk
from tidewash.llm.topk import top_k, whole_numbers


def test_equals_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    vectors = whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    whole = {i: np.floor(1024 * np.float32(v).astype(float)).astype(int) for i, v in rows}
    want = {}
    for q in range(0, 700, 50):
        scores = sorted(((-int(whole[q] @ whole[v]), v) for v in whole if v != q))[:5]
        want[q] = [(r + 1, v, -s) for r, (s, v) in enumerate(scores)]
    got = {}
    for r in top_k(vectors.where("id % 50 = 0"), vectors, 5, shard=20, tile=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == want


def test_ties_odd_and_repeated_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [])]
    vectors = whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in top_k(vectors.where("id = 0"), vectors, 10).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1 << 20), (0, 2, 2, 1 << 20), (0, 3, 3, 1 << 20)]
    assert top_k(vectors.where("id = 99"), vectors, 10).count() == 0
    assert top_k(vectors.limit(0), vectors.limit(0), 10).count() == 0


def test_large_numbers_are_exact(spark):
    rows = [(0, [2.9e6, 1.0]), (1, [2.9e6, 2.0]), (2, [2.9e6, 3.0])]
    vectors = whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.vec_id, r.score) for r in top_k(vectors.where("id = 0"), vectors, 2).orderBy("rank").collect()]
    assert got == [(2, (2_969_600_000**2) + 3 * 1024 * 1024), (1, (2_969_600_000**2) + 2 * 1024 * 1024)]


def test_vectors_go_through_no_single_task(spark, monkeypatch):
    plans, staged = [], topk.staged

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    monkeypatch.setattr(topk, "staged", recorded)
    rows = [(i, [float(i % 7), 1.0]) for i in range(200)]
    vectors = whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert top_k(vectors.where("id < 3"), vectors, 4, shard=10).count() == 12
    assert len(plans) == 2 and not any("Window" in p for p in plans)


def test_rows_without_an_identifier_take_no_part(spark):
    rows = [(0, [1.0]), (None, [9.0]), (1, [2.0]), (None, None)]
    vectors = whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [r.vec_id for r in top_k(vectors.where("id = 0"), vectors, 5).collect()] == [1]
