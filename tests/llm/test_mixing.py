import pytest
from pyspark.sql import functions as F

from tidewash.llm.mixing import mix, targets, word_count


def water_filled(sizes, weights=(1, 2, 3), passes=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left, share = total - sum(passes * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: passes * sizes[s] if s in full else left * weight[s] / share for s in names}
        above = {s for s in names if target[s] > passes * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 1, None: 10}, {"b": 5}, {"a": 1, "b": 2, "c": 3, "d": 1000}, {"é": 0, "z": 10, None: 4},
])
def test_targets_share_the_total(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(water_filled(sizes))


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "id * 7919 % 50 AS n")
    first, again = (sorted(map(tuple, mix(d, F.col("n")).collect())) for d in (docs, docs.repartition(5)))
    assert [(r[0], r[5]) for r in first] == [(r[0], r[5]) for r in again]
    taken, target = {}, {}
    for _, source, size, _, want, got in first:
        taken[source], target[source] = taken.get(source, 0) + got, want
        assert 0 <= got <= 3 * size and (size == 0 or got % size == 0)
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)
    assert abs(sum(taken.values()) - sum(r[2] for r in first)) <= 50


def test_odd_rows(odd_docs):
    rows = mix(odd_docs, word_count(F.col("text"))).collect()
    assert len(rows) == 10 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.id in (3, 4, 7)} == {0}


def test_no_rows(no_docs):
    assert mix(no_docs, word_count(F.col("text"))).count() == 0


def test_carried_columns(odd_docs):
    rows = mix(odd_docs, F.lit(2), carry=("lang", "key")).collect()
    assert sorted((str(r.id), str(r.lang)) for r in rows) == sorted((str(r.doc_id), str(r.lang)) for r in odd_docs.collect())
