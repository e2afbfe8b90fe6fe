"""One query per operator: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.functions import blank_to_null, null_tokens, number_with_unit, parse_timestamp, spreadsheet_text, to_number
from tidewash.functions.text import READER_NA_TOKENS
from tidewash.operators import columns, conversion, missing, outliers, profile, quantiles, semantic, stats, validate
from tidewash.plans import apply_steps, clean_csv, clean_table, run_steps
from tidewash.sinks import cut_cells, iso_timestamps, json_safe, spreadsheet_safe, write_csv, write_json, write_parquet
from tidewash.sources import LoadError, list_specs, load_spec, read_csv, read_table
from tidewash.sources.tables import shared_folder

from .views import base, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Fields of the part views. The patterns are fixed values.
PART_SPEC = {
    "fields": {
        "Capacity": {
            "aliases": ["storage", "room", "disk", "tape"], "type": "numeric", "unit": "GB",
            "pattern": r"(\d+)\s*(GB|TB|MB)", "unit_standardization": True, "unit_pattern": r"(\d+\.?\d*)\s*(MB|GB|TB)",
        },
        "Heft": {"aliases": ["mass"], "type": "numeric", "unit": "kg", "pattern": r"(\d+\.?\d*)\s*kg"},
        "ListPrice": {"aliases": ["cost"], "type": "numeric", "unit": "USD"},
        "Maker": {"aliases": ["maker_name"], "type": "categorical"},
        "BRAND": {"aliases": ["make"], "type": "categorical"},
    }
}
CUSTOMER_SPEC = {
    "fields": {
        "num_a": {"type": "numeric", "required": True, "max": 150},
        "seg": {"type": "numeric", "required": True},
        "bal": {"type": "numeric", "min": 0, "max": 5000},
        "allnull": {"type": "string"},
        "c_custkey": {"type": "datetime", "required": True},
        "discount": {"type": "numeric"},
    }
}


def clean_customer(spark: SparkSession, sf: str) -> DataFrame:
    """dirty_customer with missing tokens already null."""
    return missing.normalise_missing(view(spark, sf, "dirty_customer"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else c for c in df.columns])


# --- Cells, columns and rows ------------------------------------------------
@query
def blank_and_token_nulls(spark, sf):
    return clean_customer(spark, sf).select("c_custkey", "seg")


@query
def reader_na_tokens(spark, sf):
    cell = blank_to_null(null_tokens(F.col("seg"), READER_NA_TOKENS))
    return view(spark, sf, "dirty_customer").select("c_custkey", cell.alias("seg"))


@query
def trim_only(spark, sf):
    return missing.trim_strings(view(spark, sf, "dirty_customer")).select("c_custkey", "seg")


@query
def missing_profile(spark, sf):
    return stats.missing_profile(clean_customer(spark, sf))


@query
def drop_empty_columns(spark, sf):
    return missing.drop_empty_columns(clean_customer(spark, sf))


@query
def drop_sparse_columns(spark, sf):
    return missing.drop_empty_columns(clean_customer(spark, sf), threshold=0.5)


@query
def dedupe_rows(spark, sf):
    return missing.dedupe_rows(view(spark, sf, "dup_orders"))


@query
def dedupe_subset(spark, sf):
    return missing.dedupe_subset(view(spark, sf, "keyed_orders"), ["k", "o_orderstatus"], order_by="o_orderkey")


@query
def sample_head(spark, sf):
    return columns.head_rows(base(spark, sf, "orders"), 10, "o_orderkey")


@query
def sample_distinct(spark, sf):
    found = stats.first_distinct(base(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], order_by="o_orderkey")
    rows = [(c, i + 1, v) for c, values in found.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "column string, position bigint, value string")


@query
def finite_only(spark, sf):
    return missing.finite_only(view(spark, sf, "odd_numbers"))


# --- Imputation -------------------------------------------------------------
@query
def impute_median(spark, sf):
    return rounded(missing.impute(clean_customer(spark, sf), "median", "none").select("c_custkey", "num_a", "bal"))


@query
def impute_mean(spark, sf):
    return rounded(missing.impute(clean_customer(spark, sf), "mean", "none").select("c_custkey", "num_a", "bal"))


@query
def impute_zero(spark, sf):
    return missing.impute(clean_customer(spark, sf), "zero", "none").select("c_custkey", "num_a", "bal")


@query
def impute_numeric_mode(spark, sf):
    return missing.impute(clean_customer(spark, sf), "mode", "none").select("c_custkey", "num_a", "bal")


@query
def impute_fixed(spark, sf):
    table = missing.impute(clean_customer(spark, sf), "fixed", "fixed", fixed_numeric=-1, fixed_categorical="OTHER")
    return table.select("c_custkey", "num_a", "bal", "seg")


@query
def impute_nothing(spark, sf):
    return missing.impute(clean_customer(spark, sf), "none", "none")


@query
def impute_mode(spark, sf):
    return missing.impute(clean_customer(spark, sf), "none", "mode").select("c_custkey", "seg", "allnull")


@query
def impute_unknown(spark, sf):
    return missing.impute(clean_customer(spark, sf), "none", "unknown").select("c_custkey", "seg", "allnull")


@query
def imputation_accounting(spark, sf):
    return missing.fit_imputation(clean_customer(spark, sf)).table(spark)


# --- Types ------------------------------------------------------------------
@query
def unit_extract(spark, sf):
    part = view(spark, sf, "dirty_part")
    return part.select("p_partkey", *[number_with_unit(F.col(c)).alias(c) for c in ("storage", "mass", "brand")])


@query
def unit_standardise(spark, sf):
    renamed = columns.apply_mapping(view(spark, sf, "dirty_part"), PART_SPEC)
    only = {"fields": {"Capacity": PART_SPEC["fields"]["Capacity"]}}
    return rounded(conversion.apply_spec(renamed, only)[0].select("p_partkey", "Capacity"))


@query
def schema_extract(spark, sf):
    renamed = columns.apply_mapping(view(spark, sf, "dirty_part"), PART_SPEC)
    fields = {k: {o: v for o, v in f.items() if not o.startswith("unit_")} for k, f in PART_SPEC["fields"].items()}
    return rounded(conversion.apply_spec(renamed, {"fields": fields})[0])


@query
def schema_extract_counts(spark, sf):
    renamed = columns.apply_mapping(view(spark, sf, "dirty_part"), PART_SPEC)
    plan = conversion.apply_spec(renamed, PART_SPEC)[1]
    return plan.table(spark).select("column", "action", "converted_count", "unit", "pattern_used")


@query
def rule_extract(spark, sf):
    rules = {"storage": {"regex": r"(\d+)\s*[GT]B", "unit": "GB"}, "mass": {"regex": r"(\d+\.\d+)", "unit": "kg"}}
    return rounded(conversion.apply_rules(view(spark, sf, "dirty_part"), rules)[0])


@query
def numeric_coerce(spark, sf):
    part = view(spark, sf, "dirty_part")
    return part.select("p_partkey", to_number(F.col("cost")).alias("cost"), to_number(F.col("storage")).alias("storage"))


@query
def datetime_coerce(spark, sf):
    return view(spark, sf, "dirty_dates").select("o_orderkey", parse_timestamp("d").alias("d"))


@query
def type_ladder_counts(spark, sf):
    part = conversion.ladder_counts(view(spark, sf, "dirty_part"))
    return part.unionByName(conversion.ladder_counts(view(spark, sf, "dirty_dates")))


@query
def type_conversions(spark, sf):
    parts = [conversion.fit_conversions(view(spark, sf, v)).table(spark) for v in ("dirty_part", "dirty_dates")]
    return parts[0].unionAll(parts[1]).select("column", "after_dtype", "action", "reason", "converted_count")


@query
def type_converted_total(spark, sf):
    plans = {v: conversion.fit_conversions(view(spark, sf, v)) for v in ("dirty_part", "dirty_dates")}
    rows = [(v, p.converted_total) for v, p in plans.items()]
    return spark.createDataFrame(rows, "source string, converted_count bigint")


@query
def convert_part(spark, sf):
    return conversion.convert_types(view(spark, sf, "dirty_part"))


@query
def convert_disabled(spark, sf):
    return conversion.convert_types(view(spark, sf, "dirty_part"), convert=False)


@query
def convert_dates(spark, sf):
    return conversion.convert_types(view(spark, sf, "dirty_dates"))


@query
def reader_types(spark, sf):
    text = base(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_tax").cast("string").alias("l_tax"),
        (F.col("l_linenumber") > 3).cast("string").alias("late"), "l_returnflag", "l_linenumber",
    )
    return conversion.convert_types(text, read_types=True)


# --- Names ------------------------------------------------------------------
@query
def field_mapping_report(spark, sf):
    part = view(spark, sf, "dirty_part")
    counts = stats.missing_profile(part).select(F.col("column").alias("original"), "row_count", "missing_count")
    return columns.mapping_report(part, PART_SPEC).join(counts, "original")


@query
def field_mapping_apply(spark, sf):
    return columns.apply_mapping(view(spark, sf, "dirty_part"), PART_SPEC)


@query
def duplicate_names(spark, sf):
    return columns.resolve_duplicates(columns.apply_mapping(view(spark, sf, "clashing_part"), PART_SPEC))


# --- Statistics -------------------------------------------------------------
@query
def numeric_stats(spark, sf):
    tables = [stats.numeric_stats_table(base(spark, sf, t)) for t in ("events", "orders", "part")]
    return rounded(tables[0].unionAll(tables[1]).unionAll(tables[2]), 4)


@query
def numeric_stats_odd(spark, sf):
    table = stats.numeric_stats_table(view(spark, sf, "odd_numbers"), ["v"])
    return table.select("column", "row_count", "null_count", "min", "max", F.round("median", 6).alias("median"))


@query
def quartiles(spark, sf):
    from tidewash.operators.quantiles import exact_quantiles

    table = base(spark, sf, "lineitem")
    found = exact_quantiles(table, columns.numeric_columns(table), (0.25, 0.5, 0.75))
    return rounded(spark.createDataFrame([(c, *q) for c, q in found.items()], "column string, q1 double, median double, q3 double"))


@query
def box_plot(spark, sf):
    return rounded(profile.box_plot(base(spark, sf, "lineitem")))


@query
def column_stats(spark, sf):
    table = profile.column_stats(base(spark, sf, "orders"))
    top = F.array_join(F.transform("top_5_values", lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), "|")
    return rounded(table.withColumn("top_5_values", top), 4)


@query
def value_counts_top5(spark, sf):
    events = stats.value_counts(base(spark, sf, "events"), ["event_type", "props"])
    orders = stats.value_counts(base(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return events.unionAll(orders)


@query
def category_shares(spark, sf):
    return rounded(profile.category_shares(base(spark, sf, "events"), "event_type"))


@query
def distinct_exact(spark, sf):
    return stats.distinct_counts(base(spark, sf, "lineitem"))


@query
def distinct_estimated(spark, sf):
    lines = base(spark, sf, "lineitem")
    estimated = stats.estimated_distinct_counts(lines).withColumnRenamed("distinct_count", "estimate")
    near = F.abs(F.col("estimate") - F.col("distinct_count")) <= F.greatest(F.lit(1), 5 * stats.DISTINCT_ERROR * F.col("distinct_count"))
    return stats.distinct_counts(lines).join(estimated, "column").select("column", "distinct_count", near.alias("within_error"))


@query
def distinct_decimal(spark, sf):
    prices = base(spark, sf, "lineitem").select((F.lit(1234567890123456789).cast("decimal(38,10)") + F.col("l_linenumber").cast("decimal(38,10)") / 1000).cast("decimal(38,10)").alias("wide"), "l_orderkey")
    return stats.distinct_counts(prices)


@query
def quantiles_extreme(spark, sf):
    """Low ranks among infinities: below them all, and between an infinity and a number."""
    found = quantiles.exact_quantiles(view(spark, sf, "odd_numbers"), ["v"], [0.0, 0.1, 0.5, 0.9, 1.0])["v"]
    rows = [(i, None if q is None else repr(q) if math.isinf(q) else f"{q:.4f}") for i, q in enumerate(found)]
    return spark.createDataFrame(rows, "place int, quantile string")


@query
def value_counts_text(spark, sf):
    """Whole long texts as values."""
    pages = base(spark, sf, "pages").select(F.concat(F.lit("<html>" * 10), F.substring("html", 1, 3)).alias("start"), "html")
    counts = stats.value_counts(pages, ["start", "html"], 7)
    return counts.select("column", "rank", F.md5("value").alias("value_md5"), "count", "unique_count")


@query
def impute_decimal_mode(spark, sf):
    """The most frequent price, as a decimal of 20 digits."""
    part = base(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") + F.expr("12345678901234567890.25BD")).cast("decimal(24,2)")).alias("price"))
    return missing.impute(part, numeric="mode").select("p_partkey", F.col("price").cast("string").alias("price"))


@query
def datetime_formats(spark, sf):
    """Dates written in many ways, read back."""
    formats = ("M/d/yy", "MM.dd.yyyy", "yyyyMMdd", "M/d/yyyy h:mm a", "d-MMM-yy", "EEE, dd MMM yyyy HH:mm:ss", "dd/MM/yyyy", "MMMM d, yyyy")
    date = F.col("o_orderdate")
    texts = F.array(*[F.concat(F.date_format(date, f), F.lit(" GMT" if f.startswith("EEE") else "")) for f in formats])
    # Only dd/MM/yyyy is read as month first up to the 12th.
    orders = base(spark, sf, "orders").where((F.dayofmonth("o_orderdate") > 12) | (F.col("o_orderkey") % len(formats) != formats.index("dd/MM/yyyy")))
    written = orders.select("o_orderkey", F.element_at(texts, (F.col("o_orderkey") % len(formats) + 1).cast("int")).alias("d"))
    return written.select("o_orderkey", parse_timestamp("d").cast("date").cast("string").alias("day"))


@query
def histogram_counts(spark, sf):
    return rounded(profile.histogram(base(spark, sf, "events"), "value"))


@query
def histogram_gaussian(spark, sf):
    return rounded(profile.histogram(base(spark, sf, "events"), "value", gaussian=True))


@query
def overview(spark, sf):
    return profile.overview(base(spark, sf, "lineitem"))


@query
def profile_table(spark, sf):
    events = base(spark, sf, "events")
    table = profile.profile_table(events, semantic_types=semantic.infer_semantic_types(events), order_by="event_id")
    return rounded(table.withColumn("sample_values", F.array_join("sample_values", "|")), 4)


@query
def profile_large(spark, sf):
    """A key with ties, which the smaller value breaks, and counts that are exact at any size."""
    lines = base(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    table = profile.profile_table(lines, order_by="id")
    return rounded(table.withColumn("sample_values", F.array_join("sample_values", "|")), 4)


# --- Outliers ---------------------------------------------------------------
@query
def outlier_bounds(spark, sf):
    events = outliers.limits_table(base(spark, sf, "events"))
    return rounded(events.unionAll(outliers.limits_table(base(spark, sf, "documents"))))


@query
def outlier_detect(spark, sf):
    return outliers.detect_outliers(base(spark, sf, "events"), "event_id")


@query
def outlier_rows(spark, sf):
    table = outliers.outlier_rows(base(spark, sf, "events"))
    return table.withColumn("outlier_columns", F.array_join("outlier_columns", ","))


@query
def outlier_rows_of_column(spark, sf):
    return outliers.outlier_rows_by_column(base(spark, sf, "events"))["value"]


@query
def outlier_remove_any(spark, sf):
    return outliers.remove_outliers(base(spark, sf, "events"))


@query
def outlier_remove_selected(spark, sf):
    return outliers.remove_outliers(base(spark, sf, "documents"), ["n_chars", "lang", "no_such_column"]).select("doc_id", "n_chars")


@query
def outlier_removal_counts(spark, sf):
    return outliers.removal_counts(base(spark, sf, "events"), ["value"])


@query
def outlier_summary(spark, sf):
    def flat(table):
        return table.select(
            "column", "outlier_count", "total_count", "percentage",
            F.array_join(F.col("sample_values").cast("array<string>"), "|").alias("sample_values"),
            F.array_join(F.col("sample_indices").cast("array<string>"), "|").alias("sample_indices"),
        )

    events = outliers.outlier_summary(base(spark, sf, "events"), "event_id")
    return flat(events).unionAll(flat(outliers.outlier_summary(base(spark, sf, "documents"), "doc_id")))


@query
def outlier_threshold_3(spark, sf):
    return outliers.remove_outliers(base(spark, sf, "events"), ["value"], k=3.0)


@query
def outlier_remove_reindexed(spark, sf):
    """Numbers without gaps after rows have gone."""
    events = columns.with_row_id(base(spark, sf, "events"))
    return outliers.remove_outliers(events, ["value"], renumber=True).select("_row_id", "event_id")


@query
def outlier_totals(spark, sf):
    totals = outliers.outlier_overview(base(spark, sf, "lineitem"))
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{name} bigint" for name in totals))


# --- Semantic types ---------------------------------------------------------
@query
def semantic_ratios(spark, sf):
    mix = semantic.text_ratios(view(spark, sf, "semantic_mix"))
    pages = semantic.text_ratios(base(spark, sf, "pages"))
    return rounded(mix.unionAll(pages))


@query
def semantic_types(spark, sf):
    tables = [view(spark, sf, "semantic_mix"), *[base(spark, sf, t) for t in ("documents", "pages", "events", "conversations")]]
    result = semantic.semantic_types_table(tables[0])
    for t in tables[1:]:
        result = result.unionAll(semantic.semantic_types_table(t))
    return result


@query
def semantic_rest(spark, sf):
    """No values, dates as text, other texts, longitudes, free text of varied words, and a type that has no rule."""
    return semantic.semantic_types_table(view(spark, sf, "semantic_rest").withColumn("parts", F.split("code", "e")))


# --- Validation -------------------------------------------------------------
@query
def validate_spec(spark, sf):
    return validate.validate_spec(clean_customer(spark, sf), CUSTOMER_SPEC)


@query
def validate_required(spark, sf):
    spec = {"fields": {c: {"required": True} for c in ("c_custkey", "num_a", "seg", "bal", "allnull")}}
    return validate.validate_spec(clean_customer(spark, sf), spec)


@query
def validate_range(spark, sf):
    spec = {"fields": {"l_quantity": {"min": 5, "max": 45}, "l_tax": {"min": 0, "max": 1}, "l_discount": {"max": 0.05}}}
    return validate.validate_spec(base(spark, sf, "lineitem"), spec)


@query
def validate_types(spark, sf):
    spec = {"fields": {"event_id": {"type": "string"}, "ts": {"type": "datetime"}, "value": {"type": "boolean"}, "props": {"type": "datetime"}}}
    return validate.validate_spec(base(spark, sf, "events"), spec)


@query
def validate_table(spark, sf):
    return validate.validate_table(columns.apply_mapping(view(spark, sf, "clashing_part"), PART_SPEC))[0]


@query
def validate_failures(spark, sf):
    """What makes a table unusable, as rows."""
    customers = clean_customer(spark, sf)
    issues = validate.table_issues(customers.select("c_custkey", F.col("bal").alias(" "), "allnull"))
    return spark.createDataFrame(issues + validate.table_issues(customers.where("c_custkey < 0")), validate.ISSUE_SCHEMA)


# --- Outputs ----------------------------------------------------------------
@query
def spreadsheet_cells(spark, sf):
    safe = base(spark, sf, "documents").select("doc_id", spreadsheet_text(F.concat("text", F.lit("\x07\x0b end"), "text")).alias("text"))
    return safe.select("doc_id", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("text_md5"))


@query
def spreadsheet_cut_cells(spark, sf):
    """Cells that a shorter limit cuts, counted, and the texts cut."""
    docs = base(spark, sf, "documents")
    cut = spreadsheet_safe(docs.select("doc_id", "text"), 500).select("doc_id", F.length("text").cast("bigint").alias("length"))
    counts = cut_cells(docs, 500).select(F.col("column").alias("name"), "cut_count")
    return cut.select(F.col("doc_id").cast("string").alias("name"), F.col("length").alias("number")).unionAll(counts)


@query
def timestamp_texts(spark, sf):
    """Timestamps in ISO form, and with a time zone as the wall clock."""
    orders = base(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 1, 2, 3.004005)")).alias("at"))
    clock = spreadsheet_safe(orders.select("o_orderkey", F.col("at").cast("timestamp").alias("clock")))
    return iso_timestamps(orders).join(clock, "o_orderkey")


@query
def spreadsheet_table(spark, sf):
    odd = view(spark, sf, "odd_numbers").withColumn("pair", F.struct(F.col("o_orderkey").alias("k"), F.lit("a\x01b").alias("t")))
    return spreadsheet_safe(odd)


@query
def json_rows(spark, sf):
    return json_safe(view(spark, sf, "odd_numbers")).select("o_orderkey", F.to_json(F.struct("v"), {"ignoreNullFields": "false"}).alias("line")).withColumn(
        "has_value", F.col("line").rlike(r"\d")
    ).select("o_orderkey", "has_value", (~F.col("line").rlike("NaN|Infinity")).alias("is_plain"))


@query
def csv_roundtrip(spark, sf):
    """Texts with quotes, commas and line breaks, through our CSV sink and source."""
    folder = shared_folder(spark)
    write_csv(base(spark, sf, "documents"), folder)
    rows = read_csv(spark, folder, row_id=False).df.select("doc_id", "n_chars", "lang", "source", F.md5("text").alias("text_md5"))
    return conversion.fit_conversions(rows.select("doc_id", "n_chars", "lang"), read_types=True).apply(rows)


@query
def csv_row_order(spark, sf):
    """Small first files and large last ones: rows are numbered in the order of the input."""
    folder, orders = shared_folder(spark), base(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit('\n"x",')).alias("clerk"))
    bounds = (0, 10, 500, 1 << 62)
    for name, low, high in zip("abc", bounds, bounds[1:]):
        write_csv(orders.where((F.col("o_orderkey") >= low) & (F.col("o_orderkey") < high)).orderBy("o_orderkey"), f"{folder}/{name}")
    table = columns.dense_row_id(read_csv(spark, [f"{folder}/{name}" for name in "abc"]).df)
    return table.select("_row_id", F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "clerk")


@query
def parquet_roundtrip(spark, sf):
    folder = shared_folder(spark)
    write_parquet(view(spark, sf, "dirty_customer"), folder)
    return read_table(spark, folder)


@query
def encoding_fallback(spark, sf):
    """A Latin-1 file is not valid UTF-8, so the second encoding is used."""
    folder = shared_folder(spark)
    names = base(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" café")).alias("label"))
    names.write.options(header=True, encoding="ISO-8859-1").csv(folder)
    table = read_csv(spark, folder)
    return table.df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "label", F.lit(table.encoding).alias("encoding"))


@query
def load_metadata(spark, sf):
    folder = shared_folder(spark)
    write_csv(base(spark, sf, "orders"), folder)
    return read_csv(spark, folder).metadata()


@query
def csv_mixed_headers(spark, sf):
    """Files with the same columns in another order meet by name."""
    folder, orders = shared_folder(spark), base(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    write_csv(orders.where("o_orderkey % 3 = 0"), f"{folder}/a")
    write_csv(orders.where("o_orderkey % 3 <> 0").select("o_orderpriority", "o_custkey", "o_orderkey"), f"{folder}/b")
    table = read_csv(spark, [f"{folder}/a", f"{folder}/b"], row_id=False).df
    return table.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderpriority")


@query
def lineage_json(spark, sf):
    """The lineage as written and read again."""
    folder = shared_folder(spark)
    write_json(clean_table(view(spark, sf, "dup_orders"), {"remove_outliers": True}, profile=False).lineage, folder)
    return spark.read.json(folder).select("action", "affected_count")


@query
def report_json(spark, sf):
    """The report as written and read again: every field in the order of its name, as text."""
    folder = shared_folder(spark)
    write_json(clean_table(view(spark, sf, "dirty_customer"), spec=CUSTOMER_SPEC).report(), folder)
    report = spark.read.json(folder)

    def rows(section: str, table: DataFrame, key: str, *values: str) -> DataFrame:
        cells = [F.coalesce(F.round(F.col(v), 4).cast("string") if dict(table.dtypes)[v] == "double" else F.col(v).cast("string"), F.lit("-")) for v in values]
        return table.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("name"), F.concat_ws("|", *cells).alias("value"))

    numbers = ["rows_before", "rows_after", "columns_before", "columns_after", "duplicates_removed", "outliers_removed", "missing_filled_total", "converted_total"]
    out = report.select(F.lit("summary").alias("section"), F.explode(F.create_map(*[x for n in numbers for x in (F.lit(n), F.col(n).cast("string"))])).alias("name", "value"))
    for name in ("missing_before", "missing_after", "missing_filled_per_column", "semantic_types"):
        texts = {"ignoreNullFields": "true"}
        out = out.unionAll(report.select(F.lit(name), F.explode(F.from_json(F.to_json(name, texts), "map<string,string>")).alias("name", "value")))
    profile_rows = report.select(F.inline("profile"))
    out = out.unionAll(rows("profile", profile_rows, "column", "dtype", "missing_count", "distinct_count", "is_numeric", "is_categorical", "min", "max", "q1", "median", "q3", "outlier_count"))
    out = out.unionAll(rows("lineage", report.select(F.inline("lineage")), "action", "affected_count"))
    out = out.unionAll(rows("issues", report.select(F.inline("schema_validation")), "column", "issue"))
    out = out.unionAll(rows("mapping", report.select(F.inline("field_mapping")), "original", "mapped_to", "match_type"))
    samples = F.from_json("samples", "struct<before:struct<c_custkey:array<string>>,after:struct<c_custkey:array<string>>>")
    return out.unionAll(report.select(F.lit("samples"), F.lit("sizes"), F.concat_ws("|", F.size(samples["before"]["c_custkey"]), F.size(samples["after"]["c_custkey"]))))


# --- Runs -------------------------------------------------------------------
@query
def clean_run(spark, sf):
    return rounded(clean_table(view(spark, sf, "dirty_customer"), profile=False).df)


@query
def clean_run_spec(spark, sf):
    rules = {"fill_missing_numeric": "mean"}
    return rounded(clean_table(view(spark, sf, "dirty_part"), rules, PART_SPEC, profile=False).df)


@query
def clean_run_outliers(spark, sf):
    return clean_table(base(spark, sf, "events"), {"remove_outliers": True}, profile=False).df


@query
def clean_run_csv(spark, sf):
    folder = shared_folder(spark)
    write_csv(view(spark, sf, "dirty_customer"), folder)
    return rounded(clean_csv(spark, folder, profile=False).df.drop("_row_id"))


@query
def run_summary(spark, sf):
    summary = clean_table(view(spark, sf, "dirty_customer"), profile=False).summary
    return summary.select(
        "rows_before", "rows_after", "columns_before", "columns_after", "duplicates_removed",
        F.array_join("columns_dropped", ",").alias("columns_dropped"), "missing_filled_total",
        F.element_at("missing_before", "seg").alias("seg_missing_before"), F.element_at("missing_after", "seg").alias("seg_missing_after"),
    )


@query
def run_issues(spark, sf):
    return clean_table(view(spark, sf, "dirty_customer"), spec=CUSTOMER_SPEC, profile=False).issues


@query
def lineage_counts(spark, sf):
    result = clean_table(view(spark, sf, "dup_orders"), {"remove_outliers": True}, profile=False)
    return result.lineage.select("action", "affected_count")


@query
def lineage_every_count(spark, sf):
    """A table in which each step finds something."""
    spec = {"fields": {"state": {"aliases": ["st"], "type": "categorical"}}}
    result = clean_table(view(spark, sf, "messy_orders"), {"remove_outliers": True}, spec, profile=False)
    return result.lineage.select("action", "affected_count")


@query
def spec_file_run(spark, sf):
    """A spec written as a file, found, loaded and applied."""
    folder = f"{shared_folder(spark)}/specs"
    text = spark.createDataFrame([(json.dumps(PART_SPEC),)], "text string")
    text.select(F.from_json("text", F.schema_of_json(F.lit(json.dumps(PART_SPEC)))).alias("spec")).select("spec.*").coalesce(1).write.json(folder)
    spec = load_spec(spark, f"{folder}/{list_specs(spark, folder)[0]}")
    return rounded(clean_table(view(spark, sf, "dirty_part"), {"fill_missing_numeric": "mean"}, spec, profile=False).df)


@query
def rules_from_settings(spark, sf):
    """Rules from the session's settings, one of them overridden."""
    name = "spark.tidewash.cleaningRules"
    spark.conf.set(name, json.dumps({"fill_missing_numeric": "fixed", "fill_value_numeric": -1, "fill_missing_categorical": "fixed", "fill_value_categorical": "x"}))
    try:
        return clean_table(view(spark, sf, "dirty_customer"), {"fill_value_categorical": "OTHER"}, profile=False).df
    finally:
        spark.conf.unset(name)


@query
def outlier_free_csv(spark, sf):
    """The second output of a run: the cleaned table without outlier rows, as CSV."""
    folder = shared_folder(spark)
    write_csv(outliers.remove_outliers(clean_table(base(spark, sf, "events"), profile=False).df), folder)
    rows = read_csv(spark, folder, row_id=False).df.select("event_id", "user_id", "event_type", "value", "props")
    return conversion.convert_types(rows, read_types=True).withColumn("value", F.round("value", 6))


@query
def csv_rejections(spark, sf):
    """Files that are no tables, with what the reader says of them."""
    folder, nation = shared_folder(spark), base(spark, sf, "nation").repartition(1)
    write_csv(nation.where("n_nationkey >= 0"), f"{folder}/good")
    write_csv(nation.where("n_nationkey < 0"), f"{folder}/header only")
    write_csv(nation.select(F.lit(None).cast("string").alias("a"), F.lit("NA").alias("b")), f"{folder}/no values")
    nation.select(F.lit("")).write.text(f"{folder}/blank lines")
    nation.select(F.concat(F.lit('a,b\n"'), "n_name")).write.text(f"{folder}/open quote")
    out = []
    for name in ("good", "header only", "no values", "blank lines", "open quote", "absent"):
        try:
            out.append((name, str(read_csv(spark, f"{folder}/{name}").df.count())))
        except LoadError as e:
            out.append((name, str(e).split(" at ")[0].split(" in ")[0]))
    return spark.createDataFrame(out, "case string, outcome string")


@query
def steps_run(spark, sf):
    steps = [
        {"step": "trim_whitespace"},
        {"step": "drop_empty_columns", "threshold": 0.9},
        {"step": "deduplicate", "subset": ["num_a"]},
        {"step": "impute", "strategy": "mean"},
        {"step": "remove_outliers", "threshold": 0.5},
    ]
    keyed = view(spark, sf, "dirty_customer")
    return rounded(apply_steps(columns_ordered(keyed), {"pipeline": {"steps": steps}}))


@query
def steps_report(spark, sf):
    steps = [{"step": "deduplicate"}, {"step": "remove_outliers", "threshold": 100}]
    result = run_steps(view(spark, sf, "dup_orders"), steps)
    actions = F.lit(",".join(e.action for e in result.events)).alias("actions")
    return result.report().select("rows_before", "rows_after", "duplicates_removed", "outliers_removed", actions)


def columns_ordered(df: DataFrame) -> DataFrame:
    """The key as row id, so that "first" has a meaning."""
    return df.withColumnRenamed("c_custkey", "_row_id")
