"""Shape of the plans: what would hurt on a large table."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.views import base, view
from tidewash.operators import missing, outliers, profile, semantic, stats
from tidewash.plans import clean_table

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["outlier_remove_any", "datetime_coerce", "convert_part", "clean_run", "dedupe_subset"])
def test_no_python_in_plans(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "CartesianProduct" not in text


def test_ranking_keeps_few_rows_before_the_shuffle(spark):
    events = base(spark, SF, "events")
    for df in (stats.text_candidates(events, [F.col("event_type")], 5), missing.dedupe_subset(events, ["user_id"], order_by="event_id")):
        text = plan(df)
        assert text.count("WindowGroupLimit") >= 2 and text.index("Partial") >= 0 and "Python" not in text


def test_dedupe_combines_copies_before_the_shuffle(spark):
    text = plan(missing.dedupe_rows(view(spark, SF, "dup_orders")))
    assert "partial" in text.lower() or text.count("HashAggregate") >= 2
    keyed = plan(missing.dedupe_rows(view(spark, SF, "dup_orders").withColumn("_row_id", F.monotonically_increasing_id())))
    assert "partial_min" in keyed and "SortAggregate" not in keyed


def test_outlier_filter_reaches_the_scan(spark):
    text = plan(outliers.outlier_rows_by_column(base(spark, SF, "events"))["value"])
    assert "PushedFilters" in text and "value" in text.split("PushedFilters")[1].split("\n")[0]


def test_statistics_read_only_their_columns(spark):
    schema = plan(stats.missing_profile(base(spark, SF, "lineitem"), ["l_tax"])).split("ReadSchema:")[1].split("\n")[0]
    assert "l_tax" in schema and "l_quantity" not in schema


def test_value_counts_are_shuffled_once(spark):
    df = stats.text_candidates(base(spark, SF, "orders"), [F.col("o_orderstatus")], 5)
    df.collect()
    assert "ReusedExchange" in plan(df)


@pytest.mark.parametrize("run", [stats.numeric_stats, profile.profile_table, semantic.infer_semantic_types, outliers.outlier_limits])
def test_jobs_do_not_grow_with_columns(spark, jobs, run):
    narrow = spark.range(2000).selectExpr("id", "id % 17 AS c0", "concat('k', id % 5) AS s0")
    wide = spark.range(2000).selectExpr("id", *[f"id % 17 AS c{i}" for i in range(12)], *[f"concat('k', id % 5) AS s{i}" for i in range(6)])
    assert jobs(lambda: run(wide)) <= jobs(lambda: run(narrow)) + 1


def test_hot_values(spark):
    """A third of the rows share one value: results stay whole."""
    df = spark.range(0, 30_000, 1, 8).selectExpr("id AS _row_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id) END AS s", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS n")
    top = stats.value_counts(df, ["s"], 1).first()
    assert (top["value"], top["count"], top["unique_count"]) == ("hot", 10_000, 20_001)
    assert missing.dedupe_subset(df, ["s"]).count() == 20_001
    assert missing.dedupe_rows(df.drop("_row_id")).count() == 20_001
    n = next(x for x in stats.numeric_stats(df) if x.column == "n")
    assert (n.q1, n.min) == (7.0, 1.0)


def test_run_stages_once_and_stays_lazy(spark):
    result = clean_table(view(spark, SF, "dirty_customer"), profile=False)
    text = plan(result.df)
    assert "Exchange" not in text and "parquet" in text.lower()


def test_distinct_counts_send_no_texts(spark):
    text = plan(stats.distinct_counts(spark.range(10).selectExpr("CAST(id AS STRING) AS s")))
    assert "xxhash64" in text
    assert stats.distinct_counts(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "s string")).first()["distinct_count"] == 2


def test_long_texts_stay_out_of_the_first_shuffle(spark, monkeypatch):
    texts = [("x" * 20_000 + str(i % 50),) for i in range(1000)]
    df = spark.createDataFrame(texts, "s string").repartition(4)
    found = stats.text_candidates(df, [F.col("s")], 5)
    assert max(len(r["value"]["head"]) for r in found.collect()) == stats.TEXT_HEAD
    exchanges = [line for line in plan(found).split("\n") if "hashpartitioning" in line]
    assert exchanges and all("s#" not in line.split("ENSURE")[0] for line in exchanges)
    want = [("x" * 20_000 + t, 20) for t in ("0", "1", "10", "11", "12")]
    assert [(r["value"], r["count"]) for r in stats.value_counts(df, ["s"]).orderBy("rank").collect()] == want
    monkeypatch.setattr(stats, "FEW_CANDIDATES", 10)
    assert [(r["value"], r["count"]) for r in stats.value_counts(df, ["s"]).orderBy("rank").collect()] == want
    assert stats.modes(df, ["s"]) == {"s": want[0][0]}
