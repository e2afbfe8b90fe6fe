import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewash.llm import blocks, hard_negatives
from tidewash.llm.blocks import Block
from tidewash.llm.hard_negatives import rescored, spanning_tree


def brute(rows, anchors, positives=5, negatives=3, scale=256):
    whole = [(k, i, lab, [int(np.floor(scale * x)) for x in v]) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, i, lab, v in whole:
        if i % anchors:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, m, lab2) for m, j, lab2, w in whole if m != k and len(w) == len(v)]
        for s, j, _, _ in sorted(x for x in scores if x[3] == lab)[:positives]:
            inside = sorted(x for x in scores if x[3] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


def mined(df, anchors, **options):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % anchors == 0, **options).collect())


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_many_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 6)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 6 * 40)
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in middle[i % 5] + 0.6 * rng.normal(size=6)], int(rng.integers(0, 4))) for i in range(500)]
    rows += [(i, v, 3 - lab) for i, v, lab in rows[100:160]]  # repeated identifiers with other labels
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert mined(df, 10) == brute(rows, 10)


def test_bounds_spare_most_scores():
    rng = np.random.default_rng(5)
    anchors = Block(np.round(100 * (1 + 0.05 * rng.normal(size=(40, 16)))), {})
    rows = Block(np.round(100 * rng.normal(size=(1000, 16))), {})
    full = anchors.scores(rows)
    limit = np.partition(full, -20, axis=1)[:, -20]
    scored = 0
    for a, places, scores in rescored(anchors, spanning_tree(anchors.scores(anchors)), rows, lambda a, lo, hi: hi >= limit[a]):
        assert (full[a][places] == scores).all() and set(np.flatnonzero(full[a] >= limit[a])) <= set(places.tolist())
        scored += len(places)
    assert scored < 0.5 * full.size


def test_tree_is_minimal():
    v = Block(np.array([[0.0], [10.0], [11.0], [3.0]]), {})
    tree = spanning_tree(v.scores(v))
    assert sorted(d for c, p, d in tree if c != p) == [1.0, 3.0, 7.0]
    seen = set()
    for child, parent, _ in tree:
        assert parent in seen or child == parent
        seen.add(child)


def test_odd_rows(spark):
    nan = float("nan")
    one = [1.0, 0.0]
    rows = [(0, one, 1), (2, one, 1), (1, one, 1), (1, one, 1), (3, [0.9, 0.0], 2), (4, [0.6, 5.0], 2), (5, None, 2), (6, [nan, 0.0], 2), (7, [0.8, 0.0], None), (None, [0.8, 0.0], 2), (8, [0.8], 2), (9, [], 2), (10, [0.0, 0.0], 3), (20, [-1.0, 0.0], 4), (21, [-1.0, 0.0], 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("_metadata", F.lit(1))
    assert mined(df, 10) == brute(rows, 10)
    assert mined(df, 10)[0] == (0, 1, 1, 3, 65536, 256 * 230)
    assert mined(df.limit(0), 10) == [] and mined(df.where("vec_id % 10 <> 0"), 10) == []
    nulls = df.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"), "label")
    assert mined(nulls, 10) == []


def test_zero_scores_and_large_numbers(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [2.0, 1.0], 2), (3, [3.0, 1.0], 2), (10, [1e5, 3.0], 5), (11, [1e5, 4.0], 5), (12, [6e4, 4.0], 6), (13, [6e4, 5.0], 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, 10) == brute(rows, 10)
    assert mined(df, 10, scale=2**14) == brute(rows, 10, scale=2**14)
