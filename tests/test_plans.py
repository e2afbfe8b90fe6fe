import json

import pytest

from tidewash.operators.validate import ValidationError
from tidewash.plans import CleaningRules, Event, apply_steps, clean_csv, clean_table, lineage_table, parse_steps, run_steps, write_outputs
from tidewash.plans.rules import RULES_SETTING
from tidewash.plans.run import preview

SPEC = {
    "schema": {
        "fields": {
            "Ram": {"aliases": ["ram", "memory_ram"], "type": "numeric", "unit": "GB", "pattern": r"(\d+)\s*GB"},
            "Weight": {"aliases": ["WEIGHT", "mass"], "type": "numeric", "unit": "kg", "pattern": r"(\d+\.?\d*)\s*kg"},
            "Company": {"aliases": ["brand"], "type": "string", "required": True},
            "Price": {"aliases": ["product_price", "cost"], "type": "numeric", "max": 1000},
        }
    }
}
CSV = "ram,WEIGHT,Company,product_price,memory_ram,gone\n8GB,1.83kg,Dell,500,1GB,\n16GB,2.5kg,  HP ,1500,2GB,NA\n,0.75kg,None,700,3GB,\n8GB,1.83kg,Dell,500,1GB,\n"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    return str(path)


def test_whole_run(spark, csv):
    result = clean_csv(spark, csv, spec=SPEC)
    got = [tuple(r) for r in result.df.orderBy("_row_id").select("Ram", "Weight", "Company", "Price", "Ram_1").collect()]
    assert got == [(8.0, 1.83, "Dell", 500, 1.0), (16.0, 2.5, "HP", 1500, 2.0), (12.0, 0.75, "Dell", 700, 3.0)]
    s = result.summary.first()
    assert (s["rows_before"], s["rows_after"], s["columns_before"], s["columns_after"]) == (4, 3, 6, 5)
    assert s["duplicates_removed"] == 1 and s["columns_dropped"] == ["gone"] and s["missing_filled_per_column"] == {"Ram": 1, "Company": 1}
    assert s["missing_before"]["Company"] == 1 and set(s["missing_after"].values()) == {0} and s["encoding"] == "utf-8"
    assert [tuple(r) for r in result.issues.collect()] == [("Price", "value 1500 exceeds maximum 1000")]
    events = {r["action"]: r["affected_count"] for r in result.lineage.collect()}
    assert events["file_loaded"] == 4 and events["rows_dropped"] == 1 and events["nulls_imputed"] == 2 and events["columns_renamed"] == 1
    assert {r["original"]: r["match_type"] for r in result.mapping.collect()}["gone"] == "unmapped"
    assert result.semantic_types["Price"] == "CURRENCY" and result.profile.count() == 5
    assert preview(result)["Company"] == {"before": ["Dell", "  HP ", None, "Dell"], "after": ["Dell", "HP", "Dell"]}


def test_outputs(spark, csv, tmp_path):
    result = clean_csv(spark, csv, {"remove_outliers": True}, spec=SPEC)
    paths = write_outputs(result, str(tmp_path / "out"))
    assert spark.read.parquet(paths["parquet"]).count() == 3 and spark.read.csv(paths["csv"], header=True).count() == 3
    report = json.loads("".join(p.read_text() for p in (tmp_path / "out" / "report").glob("*.json")))
    assert report["rows_after"] == 3 and len(report["profile"]) == 5 and report["field_mapping"][0]["mapped_to"] == "Ram"
    assert report["semantic_types"]["Price"] == "CURRENCY" and json.loads(report["samples"])["after"]["Ram"] == [8.0, 16.0, 12.0]
    assert json.loads(report["config_used"])["remove_outliers"] is True
    assert spark.read.json(paths["lineage"]).count() == len(result.events)


def test_flags_off(spark):
    df = spark.createDataFrame([("  a ", None), ("  a ", None)], "s string, e string")
    off = {"drop_duplicates": 0, "trim_strings": False, "drop_empty_columns": False, "convert_types": False, "fill_missing_categorical": "none"}
    result = clean_table(df, off, profile=False)
    assert [tuple(r) for r in result.df.collect()] == [("  a ", None)] * 2
    assert [tuple(r) for r in result.issues.collect()] == [("e", "column has no values")]


def test_outliers_in_the_run(spark):
    df = spark.createDataFrame([(float(v), "x") for v in [1, 2, 3, 4, 5, 6, 7, 500]], "v double, s string")
    assert clean_table(df, {"remove_outliers": True}, profile=False).summary.first()["outliers_removed"] == 1
    kept = clean_table(df, {"remove_outliers": True, "outlier_threshold": 1000}, profile=False).summary.first()
    assert kept["outliers_removed"] == 0 and kept["rows_after"] == 8


def test_unusable_tables(spark):
    with pytest.raises(ValidationError, match="no rows"):
        clean_table(spark.createDataFrame([], "a long"))
    with pytest.raises(ValidationError, match="no columns"):
        clean_table(spark.createDataFrame([(None,)], "a long"))


def test_rules(spark):
    assert CleaningRules.of({"fill_missing_numeric": "MEAN", "drop_duplicates": 1}).fill_missing_numeric == "mean"
    for bad in ({"fill_missing_numeric": "x"}, {"fill_missing_categorical": "median"}, {"trim_strings": "yes"}, {"fill_missing_numeric": "fixed"}, {"drop_duplicate": False}):
        with pytest.raises(ValueError):
            CleaningRules.of(bad)
    with pytest.raises(ValueError):
        CleaningRules.of([1])
    spark.conf.set(RULES_SETTING, '{"fill_missing_numeric": "zero", "trim_strings": false}')
    try:
        rules = CleaningRules.of({"trim_strings": True}, spark)
        assert rules.fill_missing_numeric == "zero" and rules.trim_strings
        spark.conf.set(RULES_SETTING, "not json")
        assert CleaningRules.of(None, spark) == CleaningRules()
    finally:
        spark.conf.unset(RULES_SETTING)


def test_step_lists():
    (step,) = parse_steps({"pipeline": {"steps": [{"step": "impute"}]}})
    assert (step.name, step.strategy, step.apply_to) == ("impute", "median", "numeric")
    bad_steps = ["impute"], [{"strategy": "x"}], [{"step": "fly"}], [{"step": "impute", "strategy": "medain"}], [{"step": "impute", "kind": 1}], [{"step": "impute", "strategy": "fixed"}]
    for bad in ({}, {"pipeline": {}}, {"pipeline": {"steps": 3}}, *bad_steps):
        with pytest.raises(ValueError):
            parse_steps(bad)


def test_steps_run_in_the_listed_order(spark):
    df = spark.createDataFrame([(0, " a", 1.0), (1, "a", None), (2, "b", 3.0), (3, None, 3.0)], "_row_id long, s string, v double")
    trim_first = apply_steps(df, [{"step": "trim_whitespace"}, {"step": "deduplicate", "subset": ["s"]}])
    trim_last = apply_steps(df, [{"step": "deduplicate", "subset": "s"}, {"step": "trim_whitespace"}])
    assert trim_first.count() == trim_last.count() == 3  # outer blanks always go first
    filled = apply_steps(df, [{"step": "impute", "apply_to": "all"}, {"step": "type_inference"}, {"step": "drop_empty_columns"}], stage=True)
    assert [r["v"] for r in filled.orderBy("_row_id").collect()] == [1, 3, 3, 3]
    assert [r["s"] for r in filled.orderBy("_row_id").collect()] == ["a", "a", "b", "a"]
    with pytest.raises(ValueError):
        apply_steps(df, [{"step": "remove_outliers", "method": "zscore"}])


def test_steps_as_a_full_run(spark):
    df = spark.createDataFrame([(0, " NA ", 1.0, "8GB"), (1, "a", None, "16GB"), (2, "a", 3.0, None), (3, "a", 3.0, None), (4, "b", 900.0, "4GB")], "_row_id long, s string, v double, ram string")
    steps = [{"step": "trim_whitespace"}, {"step": "type_inference"}, {"step": "deduplicate"}, {"step": "impute", "apply_to": "all"}, {"step": "remove_outliers", "columns": "v"}]
    result = run_steps(df, steps, profile=True)
    assert [(r["_row_id"], r["s"], r["v"], r["ram"]) for r in result.df.orderBy("_row_id").collect()] == [(0, "a", 1, 8), (1, "a", 3, 16), (2, "a", 3, 8)]
    s = result.summary.first()
    assert (s["rows_before"], s["rows_after"], s["duplicates_removed"], s["outliers_removed"], s["missing_filled_total"]) == (5, 3, 1, 1, 3)
    assert s["missing_before"] == {"s": 1, "v": 1, "ram": 2} and set(s["missing_after"].values()) == {0}
    assert [e.action for e in result.events] == ["file_loaded", "types_converted", "rows_dropped", "nulls_imputed", "outliers_removed"]
    assert result.report().first()["rows_after"] == 3 and result.profile.count() == 3
    result.release()


def test_lineage_details_are_json(spark):
    row = lineage_table(spark, [Event("x", "y", 1, details={"v": float("nan"), "s": ["a", "b"]}), Event("z", "y", 0)]).collect()
    assert json.loads(row[0]["details"]) == {"v": "nan", "s": "a, b"} and row[1]["details"] is None
