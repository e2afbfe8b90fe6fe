import math
import re

import numpy as np
import pandas as pd
import pytest

from tidewash.operators import quantiles
from tidewash.operators.profile import box_plot, category_shares, column_stats, histogram, overview, profile_table
from tidewash.operators.stats import (
    distinct_counts,
    estimated_distinct_counts,
    first_distinct,
    missing_profile,
    modes,
    numeric_stats,
    value_counts,
)

PROBABILITIES = [0, 0.25, 0.5, 0.75, 1]


def by_sorting(values):
    v = np.sort(values)
    result = []
    for p in PROBABILITIES:
        h = (len(v) - 1) * p
        low, high = v[math.floor(h)], v[math.ceil(h)]
        share = h - math.floor(h)
        result.append(low if low == high or not share else low * (1 - share) + high * share)
    return result


def test_exact_quantiles_against_sorting(spark, monkeypatch):
    """Long tails, hot values, extreme ranges, infinities: all by narrowing, several passes."""
    monkeypatch.setattr(quantiles, "SMALL_INTERVAL", 20)
    rng, n = np.random.default_rng(0), 20_000
    normal = rng.normal(0, 1, n)
    data = pd.DataFrame(
        {
            "heavy": np.exp(normal * 60),
            "signed": rng.normal(0, 1, n) * np.exp(normal * 100),
            "hot": np.where(rng.random(n) < 0.4, 7.0, normal),
            "wide": np.concatenate([normal[:-2], [1.7e308, -1.7e308]]),
            "tiny": normal * 1e-310,
            "const": np.full(n, 3.0),
            "infinite": np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.5, -np.inf, normal)),
            "gaps": np.where(rng.random(n) < 0.5, np.nan, normal),
            "single": np.where(np.arange(n) == 5, 2.5, np.nan),
            "whole": rng.integers(-5, 5, n),
        }
    )
    df = spark.createDataFrame(data).repartition(4)
    got = quantiles.exact_quantiles(df, list(data), PROBABILITIES)
    for name in data:
        assert got[name] == by_sorting(data[name].dropna().values), name
    built_in = df.selectExpr(*[f"percentile(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), array(0, 0.25, 0.5, 0.75, 1)) AS `{c}`" for c in data]).first()
    for name in data:
        assert got[name] == pytest.approx(built_in[name], rel=1e-12), name


def test_quantiles_between_extremes(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf, -1.5e308), (1.0, 1.5e308), (2.0, None), (3.0, None)], "v double, wide double")
    got = quantiles.exact_quantiles(df, ["v", "wide"], [0.1, 0.25, 0.5])
    assert got["v"] == [-inf, -inf, 1.5] and got["wide"][2] == 0.0 and all(map(math.isfinite, got["wide"]))


def test_sketches_settle_quantiles_in_two_passes(spark, monkeypatch):
    """One pass with sketches and one that counts; no narrowing, also for long tails and hot values."""
    from checks.views import base

    passes = []
    ranked = quantiles._ranked_bins
    monkeypatch.setattr(quantiles, "_ranked_bins", lambda *a, **k: passes.append(1) or ranked(*a, **k))
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"tail": np.exp(rng.normal(0, 40, 60_000)), "hot": np.where(rng.random(60_000) < 0.6, 1.0, rng.normal(0, 1, 60_000)), "key": np.arange(60_000)})
    got = quantiles.exact_quantiles(spark.createDataFrame(data).repartition(4), list(data), (0.25, 0.5, 0.75))
    for name in data:
        assert got[name] == pytest.approx(list(np.quantile(data[name], (0.25, 0.5, 0.75))), rel=1e-12), name
    lines = base(spark, "/root/testdata/sf0.01", "lineitem")
    got = quantiles.exact_quantiles(lines, ["l_extendedprice", "l_quantity"], (0.25, 0.5, 0.75))
    assert got["l_extendedprice"] == lines.selectExpr("percentile(l_extendedprice, array(0.25, 0.5, 0.75)) AS q").first()["q"]
    assert not passes
    # A bracket that misses its rank costs passes, not the answer.
    monkeypatch.setattr(quantiles, "around", lambda values, ps: {p: (values[0], values[0]) for p in ps})
    got = quantiles.exact_quantiles(spark.createDataFrame(data), ["tail"], (0.5, 0.75))
    assert got["tail"] == pytest.approx(list(np.quantile(data["tail"], (0.5, 0.75))), rel=1e-12) and passes


def test_quantile_passes_are_code_that_the_jvm_compiles(spark, monkeypatch, capsys):
    """It only interprets methods beyond 8,000 bytes; brackets counted by bin, and the passes after them."""
    monkeypatch.setattr(quantiles, "SMALL_INTERVAL", 4)
    monkeypatch.setattr(quantiles, "BINS", 16)
    plans, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda *a, **k: plans.append(sql(*a, **k)) or plans[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for width in (8, 30):
            names = [f"c{i}" for i in range(width)]
            data = spark.range(20_000).selectExpr(*[f"IF(id % 10 = 0, NULL, id * {i + 1} % 19997 / 7) AS {c}" for i, c in enumerate(names)])
            got = quantiles.exact_quantiles(data, names, (0.25, 0.5, 0.75))
            want = data.selectExpr(*[f"percentile({c}, array(0.25, 0.5, 0.75)) AS {c}" for c in names]).first()
            assert all(got[c] == pytest.approx(want[c], rel=1e-12) for c in names)
        capsys.readouterr()
        for plan in plans:
            plan.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(plans) >= 4 and len(sizes) >= len(plans) and max(sizes) < 8000, sizes


def test_rank_between_brackets_is_narrowed_in_its_gap(spark, monkeypatch):
    """Missed brackets of a column with rows enough for bins, next to brackets that hold their rank."""
    monkeypatch.setattr(quantiles, "SMALL_INTERVAL", 4)
    monkeypatch.setattr(quantiles, "BINS", 16)
    values = np.random.default_rng(7).permutation(np.arange(30_000.0))
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    bounds = {"v": quantiles.Bounds(30_000, 0.0, 29_999.0, {0.25: (7000.0, 8000.0), 0.5: (16_000.0, 16_500.0), 0.75: (22_000.0, 22_499.0)})}
    got = quantiles.exact_quantiles(df, ["v"], (0.25, 0.5, 0.75), bounds)
    assert got["v"] == list(np.quantile(values, (0.25, 0.5, 0.75)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_numeric_stats(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, None), (3, 1.0, None), (4, 1.0, None), (100, 1.0, 5.0)], "a long, same double, one double")
    a, same, one = numeric_stats(df)
    assert (a.q1, a.median, a.q3, a.outlier_count, a.whisker_low, a.whisker_high) == (2, 3, 4, 1, -1, 7)
    assert same.iqr == 0 and same.outlier_count == 0 and same.std == 0
    assert one.std is None and one.null_count == 4 and one.median == 5
    empty = numeric_stats(df.filter("a < 0"))[0]
    assert empty.median is None and empty.outlier_count == 0 and empty.row_count == 0


def test_value_counts_and_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 1, 1.5), ("b", 2, None), ("a", 1, 0.5), ("c", None, 0.5)], "s string, n long, d double")
    got = [tuple(r) for r in value_counts(df, ["s"], k=2).orderBy("rank").collect()]
    assert got == [("s", 1, "a", 2, 3), ("s", 2, "b", 2, 3)]
    assert modes(df, ["s", "n", "d"]) == {"s": "a", "n": 1, "d": 0.5}
    assert modes(df.filter("s = 'z'"), ["s"]) == {}
    assert {r["column"]: r["distinct_count"] for r in distinct_counts(df).collect()} == {"s": 3, "n": 2, "d": 2}
    assert {r["column"]: r["distinct_count"] for r in estimated_distinct_counts(df).collect()} == {"s": 3, "n": 2, "d": 2}


def test_first_distinct_looks_past_the_head(spark):
    rows = [(i, "a" if i < 500 else "b" if i < 700 else None if i < 800 else f"v{i % 3}", None) for i in range(1000)]
    df = spark.createDataFrame(rows, "_row_id long, s string, empty string").repartition(4)
    assert first_distinct(df) == {"s": ["a", "b", "v2", "v0", "v1"], "empty": []}
    assert sorted(first_distinct(df.drop("_row_id"), ["s"])["s"]) == ["a", "b", "v0", "v1", "v2"]


def test_missing_profile(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y")], "v double, s string")
    got = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in missing_profile(df).collect()}
    assert got == {"v": (2, 0.666667), "s": (1, 0.333333)}


def test_profile(spark):
    df = spark.createDataFrame([(i, float(i % 60), "ab"[i % 2], i % 2 == 0, [1.0]) for i in range(120)], "id long, v double, s string, b boolean, a array<double>")
    got = {r["column"]: r for r in profile_table(df, semantic_types={"s": "CATEGORICAL_LOW"}, order_by="id").collect()}
    assert got["id"]["distinct_count"] == 120 and not got["id"]["is_categorical"] and got["v"]["distinct_count"] == 60
    assert got["s"]["semantic_type"] == "CATEGORICAL_LOW" and got["v"]["semantic_type"] == "UNKNOWN"
    assert got["s"]["sample_values"] == ["a", "b"] and got["id"]["sample_values"] == ["0", "1", "2", "3", "4"]
    assert got["b"]["is_numeric"] and got["b"]["median"] is None and got["a"]["sample_values"] == ["[1.0]"]


def test_profile_counts_exactly_unless_asked_for_estimates(spark):
    df = spark.range(0, 60_001, 1, 4).selectExpr("id % 1000 AS k", "id")
    exact, estimated = ({r["column"]: r for r in profile_table(df, distinct=d).collect()} for d in ("exact", "approx"))
    assert estimated["k"]["distinct_count_estimated"] and estimated["k"]["distinct_count"] == pytest.approx(1000, rel=0.1)
    assert not exact["k"]["distinct_count_estimated"] and exact["k"]["distinct_count"] == 1000 and exact["id"]["distinct_count"] == 60_001
    with pytest.raises(ValueError):
        profile_table(df, distinct="maybe")


def test_decimals_count_in_their_own_type(spark):
    df = spark.range(5).selectExpr("CAST(12345678901234567890.5 + CAST(id % 3 AS DECIMAL(10,4)) / 1000 AS DECIMAL(38,10)) AS d")
    assert distinct_counts(df).first()["distinct_count"] == 3
    assert str(modes(df, ["d"])["d"]) == "12345678901234567890.5000000000"


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    assert [r["frequency"] for r in histogram(df, "v").orderBy("bin").collect()] == [1] + [0] * 8 + [1]


def test_column_stats_and_charts(spark):
    df = spark.createDataFrame([(1.0, "x", None), (2.0, "x", 1.0), (10.0, "y", None)], "v double, s string, lone double")
    got = {r["column"]: r for r in column_stats(df, {"s": "TEXT"}).collect()}
    assert got["s"]["unique_count"] == 2 and [tuple(x) for x in got["s"]["top_5_values"]] == [("x", 2), ("y", 1)]
    assert got["lone"]["std"] == 0.0 and got["lone"]["null_count"] == 2 and got["s"]["semantic_type"] == "TEXT"
    counts = [r["frequency"] for r in histogram(df, "v").orderBy("bin").collect()]
    assert counts == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r["frequency"] for r in histogram(flat, "v").orderBy("bin").collect()] == [2] + [0] * 9
    assert {r["frequency"] for r in histogram(flat, "v", gaussian=True).collect()} == {50}
    assert histogram(df.filter("v < 0"), "v").count() == 0
    assert {(r["value"], round(r["share"], 3)) for r in category_shares(df, "s").collect()} == {("x", 0.667), ("y", 0.333)}
    assert tuple(overview(df).first()) == (3, 3, 2, 1)
    assert [r["column"] for r in box_plot(df.withColumn("none", df.v.cast("double") * None)).collect()] == ["v", "lone"]


def test_first_distinct_breaks_ties_by_text(spark, jobs):
    # Places repeat, also around the end of the head; long texts with one head; nulls first.
    rows = [(None, "n"), *[(i // 7, f"{'y' * 40}{i * 37 % 5}" if i > 50 else "a") for i in range(400)]]
    df = spark.createDataFrame(rows, "place int, s string")
    want = sorted({s: min((p is not None, p or 0) for p, t in rows if t == s) for _, s in rows}.items(), key=lambda x: (x[1], x[0]))[:5]
    for parts in (1, 3, 8):
        got = first_distinct(df.repartition(parts), ["s"], order_by="place")
        assert got["s"] == [s for s, _ in want]
    three = spark.range(400).selectExpr("id", "'v' || id % 3 AS s")
    assert jobs(lambda: first_distinct(three, ["s"], k=4, order_by="id")) == jobs(lambda: first_distinct(three, ["s"], k=15, order_by="id"))
