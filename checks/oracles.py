"""DuckDB SQL for each query, over the same base tables."""

from __future__ import annotations

from tidewash.functions.text import MISSING_TOKENS, READER_NA_TOKENS, WHITESPACE

from .views import with_view

ORACLES: dict[str, str] = {}


def text(s: str) -> str:
    """SQL expression for a text constant; odd characters by code point."""
    parts, plain = [], ""
    for ch in s:
        if 32 <= ord(ch) < 127:
            plain += ch.replace("'", "''")
        else:
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(ch)})")
            plain = ""
    parts += [f"'{plain}'"] if plain or not parts else []
    return " || ".join(parts) if len(parts) == 1 else "(" + " || ".join(parts) + ")"


WS = text(WHITESPACE)


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def tokens(values) -> str:
    return "(" + ", ".join(text(t) for t in values) + ")"


def cleaned(c: str) -> str:
    return f"CASE WHEN {strip(c)} NOT IN {tokens(MISSING_TOKENS)} THEN {strip(c)} END"


CUSTOMER = f"""{with_view('dirty_customer')},
clean_customer AS (SELECT c_custkey, num_a, {cleaned('seg')} AS seg, bal, allnull FROM dirty_customer)"""
NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({strip(c)}, {NUMBER}) THEN TRY_CAST({strip(c)} AS DOUBLE) END"


def coerced(c: str) -> str:
    return number(f"replace(replace({c}, ',', ''), ' ', '')")


def with_unit(c: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({strip(c)}, '^([+-]?(?:\d+\.?\d*|\.\d+))\s*[a-zA-Z]+', 1), '') AS DOUBLE)"


def extracted(c: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '{pattern}', 1), '') AS DOUBLE)"


def as_time(c: str) -> str:
    return f"try_strptime({strip(c)}, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%d/%m/%Y', '%m-%d-%Y', '%d-%m-%Y', '%Y/%m/%d'])"


def unions(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# --- Cells, columns and rows ------------------------------------------------
ORACLES["blank_and_token_nulls"] = f"{CUSTOMER} SELECT c_custkey, seg FROM clean_customer"
ORACLES["reader_na_tokens"] = f"""{with_view('dirty_customer')}
SELECT c_custkey, CASE WHEN seg NOT IN {tokens(READER_NA_TOKENS)} AND {strip('seg')} <> '' THEN seg END AS seg FROM dirty_customer"""
ORACLES["trim_only"] = f"{with_view('dirty_customer')} SELECT c_custkey, {strip('seg')} AS seg FROM dirty_customer"
ORACLES["missing_profile"] = CUSTOMER + unions(
    f" SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS missing_count,"
    f" round((count(*) - count({c})) / greatest(count(*), 1), 6) AS missing_percent FROM clean_customer"
    for c in ("c_custkey", "num_a", "seg", "bal", "allnull")
)
ORACLES["drop_empty_columns"] = f"{CUSTOMER} SELECT c_custkey, num_a, seg, bal FROM clean_customer"
ORACLES["drop_sparse_columns"] = f"{CUSTOMER} SELECT c_custkey, num_a, bal FROM clean_customer"
ORACLES["dedupe_rows"] = f"{with_view('dup_orders')} SELECT DISTINCT * FROM dup_orders"
ORACLES["dedupe_subset"] = f"""{with_view('keyed_orders')}
SELECT * FROM keyed_orders QUALIFY row_number() OVER (PARTITION BY k, o_orderstatus ORDER BY o_orderkey) = 1"""
ORACLES["sample_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"
ORACLES["sample_distinct"] = "SELECT * FROM (" + unions(
    f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY first_key) AS position, CAST({c} AS VARCHAR) AS value
FROM (SELECT {c}, min(o_orderkey) AS first_key FROM orders GROUP BY {c})"""
    for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
) + ") WHERE position <= 5"
ORACLES["finite_only"] = f"{with_view('odd_numbers')} SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS v FROM odd_numbers"

# --- Imputation -------------------------------------------------------------
_MODE = "(SELECT {c} FROM clean_customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _filled(num_a: str, bal: str) -> str:
    return f"{CUSTOMER} SELECT c_custkey, {num_a} AS num_a, {bal} AS bal FROM clean_customer"


ORACLES["impute_median"] = _filled(
    "coalesce(CAST(num_a AS DOUBLE), (SELECT quantile_cont(num_a, 0.5) FROM clean_customer))",
    "round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM clean_customer)), 6)",
)
ORACLES["impute_mean"] = _filled(
    "round(coalesce(CAST(num_a AS DOUBLE), (SELECT avg(num_a) FROM clean_customer)), 6)",
    "round(coalesce(bal, (SELECT avg(bal) FROM clean_customer)), 6)",
)
ORACLES["impute_zero"] = _filled("coalesce(num_a, 0)", "coalesce(bal, 0)")
ORACLES["impute_numeric_mode"] = _filled(
    f"coalesce(num_a, {_MODE.format(c='num_a')})", f"coalesce(bal, {_MODE.format(c='bal')})"
)
ORACLES["impute_fixed"] = f"""{CUSTOMER}
SELECT c_custkey, coalesce(num_a, -1) AS num_a, coalesce(bal, -1) AS bal, coalesce(seg, 'OTHER') AS seg FROM clean_customer"""
ORACLES["impute_nothing"] = f"{CUSTOMER} SELECT * FROM clean_customer"
ORACLES["impute_mode"] = f"""{CUSTOMER}
SELECT c_custkey, coalesce(seg, {_MODE.format(c='seg')}) AS seg, coalesce(allnull, 'Unknown') AS allnull FROM clean_customer"""
ORACLES["impute_unknown"] = f"""{CUSTOMER}
SELECT c_custkey, coalesce(seg, 'Unknown') AS seg, coalesce(allnull, 'Unknown') AS allnull FROM clean_customer"""
ORACLES["imputation_accounting"] = CUSTOMER + unions(
    f" SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_before, count(*) - count({c}) AS imputed,"
    f" CAST(0 AS BIGINT) AS missing_after FROM clean_customer"
    for c in ("c_custkey", "num_a", "seg", "bal", "allnull")
)

# --- Types ------------------------------------------------------------------
PART, DATES = with_view("dirty_part"), with_view("dirty_dates")
ORACLES["unit_extract"] = (
    f"{PART} SELECT p_partkey, {with_unit('storage')} AS storage, {with_unit('mass')} AS mass, {with_unit('brand')} AS brand FROM dirty_part"
)
_STORAGE = r"(\d+\.?\d*)\s*(MB|GB|TB)"
STANDARD = f"""{PART}, parts AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(storage, '{_STORAGE}', 1), '') AS DOUBLE) AS value, regexp_extract(storage, '{_STORAGE}', 2) AS unit FROM dirty_part),
standard AS (SELECT *, value * CASE unit WHEN 'MB' THEN 1.0 / 1024 WHEN 'TB' THEN 1024 ELSE 1 END AS gb FROM parts)"""
ORACLES["unit_standardise"] = f"{STANDARD} SELECT p_partkey, round(coalesce(gb, (SELECT avg(gb) FROM standard)), 6) AS \"Capacity\" FROM standard"
_SCHEMA = f"""{PART}, found AS (SELECT p_partkey, {extracted('storage', r'(\d+)\s*(GB|TB|MB)')} AS m,
  {extracted('mass', r'(\d+\.?\d*)\s*kg')} AS w, {number('cost')} AS p, brand FROM dirty_part)"""
ORACLES["schema_extract"] = f"""{_SCHEMA}
SELECT p_partkey, round(coalesce(m, (SELECT avg(m) FROM found)), 6) AS "Capacity", round(coalesce(w, (SELECT avg(w) FROM found)), 6) AS "Heft",
  round(coalesce(p, (SELECT avg(p) FROM found)), 6) AS "ListPrice", brand AS "BRAND" FROM found"""
ORACLES["schema_extract_counts"] = f"""{STANDARD}
SELECT 'Capacity' AS "column", 'unit_standardisation' AS action, count(*) FILTER (WHERE unit IN ('MB', 'GB', 'TB') AND value IS NOT NULL) AS converted_count,
  'GB' AS unit, '{_STORAGE}' AS pattern_used FROM standard
UNION ALL SELECT 'Heft', 'schema_extraction', count({extracted('mass', r'(\d+\.?\d*)\s*kg')}), 'kg', '(\\d+\\.?\\d*)\\s*kg' FROM standard
UNION ALL SELECT 'ListPrice', 'schema_extraction', count({number('cost')}), 'USD', NULL FROM standard""".replace("\\\\", "\\")
ORACLES["rule_extract"] = f"""{PART}, found AS (SELECT p_partkey, {extracted('storage', r'(\d+)\s*[GT]B')} AS s, {extracted('mass', r'(\d+\.\d+)')} AS m, cost, brand FROM dirty_part)
SELECT p_partkey, round(coalesce(s, (SELECT avg(s) FROM found)), 6) AS storage, round(coalesce(m, (SELECT avg(m) FROM found)), 6) AS mass, cost, brand FROM found"""
ORACLES["numeric_coerce"] = f"{PART} SELECT p_partkey, {coerced('cost')} AS cost, {coerced('storage')} AS storage FROM dirty_part"
ORACLES["datetime_coerce"] = f"{DATES} SELECT o_orderkey, {as_time('d')} AS d FROM dirty_dates"


def _evidence(view: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count({with_unit(c)}) AS unit_count,"
        f" count({coerced(c)}) AS number_count, count({as_time(c)}) AS datetime_count FROM {view}"
    )


_TEXTS = [("dirty_part", c) for c in ("storage", "mass", "cost", "brand")] + [("dirty_dates", "d")]
BOTH = with_view("dirty_part", "dirty_dates")
ORACLES["type_ladder_counts"] = BOTH + " " + unions(_evidence(v, c) for v, c in _TEXTS)
_DECIDED = f"""{BOTH}, evidence AS ({unions(_evidence(v, c).replace(' AS "column"', f' AS "column", {chr(39)}{v}{chr(39)} AS source') for v, c in _TEXTS)}),
decided AS (SELECT *, CASE WHEN unit_count >= greatest(1, floor(0.3 * non_null)) THEN 'unit_extraction'
    WHEN number_count >= greatest(1, floor(0.5 * non_null)) THEN 'to_numeric'
    WHEN datetime_count >= greatest(1, floor(0.5 * non_null)) THEN 'to_datetime' ELSE 'none' END AS action FROM evidence),
counted AS (SELECT *, CASE action WHEN 'unit_extraction' THEN unit_count WHEN 'to_numeric' THEN number_count WHEN 'to_datetime' THEN datetime_count ELSE 0 END AS converted_count FROM decided)"""
ORACLES["type_conversions"] = f"""{_DECIDED}
SELECT "column", CASE action WHEN 'none' THEN 'string' WHEN 'to_datetime' THEN 'timestamp_ntz' ELSE 'double' END AS after_dtype, action,
  CASE action WHEN 'none' THEN 'no_conversion_rule_matched' END AS reason, converted_count FROM counted
UNION ALL SELECT 'p_partkey', 'bigint', 'none', 'already_numeric', 0
UNION ALL SELECT 'o_orderkey', 'bigint', 'none', 'already_numeric', 0"""
ORACLES["type_converted_total"] = f"{_DECIDED} SELECT source, CAST(sum(converted_count) AS BIGINT) AS converted_count FROM counted GROUP BY source"
ORACLES["convert_part"] = f"{PART} SELECT p_partkey, {with_unit('storage')} AS storage, {with_unit('mass')} AS mass, {coerced('cost')} AS cost, brand FROM dirty_part"
ORACLES["convert_disabled"] = f"{PART} SELECT * FROM dirty_part"
ORACLES["convert_dates"] = f"{DATES} SELECT o_orderkey, {as_time('d')} AS d FROM dirty_dates"
ORACLES["reader_types"] = "SELECT l_orderkey, l_tax, l_linenumber > 3 AS late, l_returnflag, l_linenumber FROM lineitem"

# --- Names ------------------------------------------------------------------
_MAPPED = {
    "p_partkey": ("p_partkey", "unmapped"), "storage": ("Capacity", "alias"), "mass": ("Heft", "alias"),
    "cost": ("ListPrice", "alias"), "brand": ("BRAND", "case_insensitive"),
}
ORACLES["field_mapping_report"] = PART + " " + unions(
    f"SELECT '{c}' AS original, '{to}' AS mapped_to, '{how}' AS match_type, count(*) AS row_count, count(*) - count({c}) AS missing_count FROM dirty_part"
    for c, (to, how) in _MAPPED.items()
)
ORACLES["field_mapping_apply"] = f'{PART} SELECT p_partkey, storage AS "Capacity", mass AS "Heft", cost AS "ListPrice", brand AS "BRAND" FROM dirty_part'
ORACLES["duplicate_names"] = f"""{with_view('clashing_part')}
SELECT p_partkey, room AS "Capacity", disk AS "Capacity_1", tape AS "Capacity_2", brand AS "BRAND" FROM clashing_part"""

# --- Statistics -------------------------------------------------------------
def _quartiles(c: str) -> str:
    return f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3"


def _numeric(table: str, c: str, digits: int = 4, source: str | None = None) -> str:
    """One row of numeric statistics, unrounded whiskers for the outlier test."""
    return f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count(v) AS null_count,
  round(min(v), {digits}) AS "min", round(max(v), {digits}) AS "max", round(avg(v), {digits}) AS mean, round(stddev_samp(v), {digits}) AS std,
  round(any_value(q1), {digits}) AS q1, round(any_value(median), {digits}) AS median, round(any_value(q3), {digits}) AS q3,
  round(any_value(q3 - q1), {digits}) AS iqr, round(any_value(q1 - 1.5 * (q3 - q1)), {digits}) AS whisker_low,
  round(any_value(q3 + 1.5 * (q3 - q1)), {digits}) AS whisker_high,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source or table}), (SELECT {_quartiles(c)} FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {source or table}))"""


NUMERIC = {
    "events": ("event_id", "user_id", "value"),
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"),
    "part": ("p_partkey", "p_size", "p_retailprice"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
}
ORACLES["numeric_stats"] = unions(_numeric(t, c) for t in ("events", "orders", "part") for c in NUMERIC[t])
ORACLES["numeric_stats_odd"] = f"""{with_view('odd_numbers')}
SELECT 'v' AS "column", count(*) AS row_count, count(*) - count(v) AS null_count, min(v) AS "min", max(v) AS "max", round(quantile_cont(v, 0.5), 6) AS median
FROM (SELECT CASE WHEN NOT isnan(v) THEN v END AS v FROM odd_numbers)"""
ORACLES["quartiles"] = unions(
    f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM (SELECT {_quartiles(f'CAST({c} AS DOUBLE)')} FROM lineitem)"
    for c in NUMERIC["lineitem"]
)
ORACLES["box_plot"] = unions(
    f'SELECT "column", "min", q1, median, q3, "max", whisker_low, whisker_high, outlier_count FROM ({_numeric("lineitem", c, 6)})'
    for c in NUMERIC["lineitem"]
)


def _top(table: str, c: str, k: int = 5) -> str:
    return f"""SELECT '{c}' AS "column", rank, value, "count", unique_count FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS "count", count(*) OVER () AS unique_count,
    row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) WHERE rank <= {k}"""


_BLOCK = '"min", "max", mean, std, q1, median, q3, iqr, whisker_low, whisker_high, outlier_count'
ORACLES["column_stats"] = unions(
    [
        f'SELECT "column", \'numeric\' AS type, {_BLOCK}, CAST(NULL AS BIGINT) AS unique_count, CAST(NULL AS VARCHAR) AS top_5_values, null_count, \'UNKNOWN\' AS semantic_type FROM ({_numeric("orders", c)})'
        for c in NUMERIC["orders"]
    ]
    + [
        f"""SELECT '{c}', 'categorical', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, any_value(unique_count),
  string_agg(value || '=' || "count", '|' ORDER BY rank), (SELECT count(*) - count({c}) FROM orders), 'UNKNOWN' FROM ({_top("orders", c)})"""
        for c in ("o_orderstatus", "o_orderpriority", "o_orderdate")
    ]
)
ORACLES["value_counts_top5"] = unions(
    _top(t, c) for t, c in (("events", "event_type"), ("events", "props"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"))
)
ORACLES["category_shares"] = f"""SELECT value, "count", round("count" / sum("count") OVER (), 6) AS share FROM ({_top('events', 'event_type')})"""
_LINEITEM = (*NUMERIC["lineitem"], "l_returnflag", "l_linestatus", "l_shipdate")
ORACLES["distinct_exact"] = unions(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM lineitem" for c in _LINEITEM)
_BINS = """WITH s AS (SELECT min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_samp(value) AS std FROM events),
edges AS (SELECT CAST(i AS BIGINT) AS bin, low + i * ((high - low) / 10) AS bin_start, low + i * ((high - low) / 10) + (high - low) / 10 AS bin_end, mean, std
  FROM s, generate_series(0, 9) AS t(i)),
bins AS (SELECT *, (bin_start + bin_end) / 2 AS center FROM edges)"""
ORACLES["histogram_counts"] = f"""{_BINS},
counts AS (SELECT CAST(least(floor((value - low) / ((high - low) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, round(center, 6) AS center, coalesce(n, 0) AS frequency FROM bins LEFT JOIN counts USING (bin)"""
ORACLES["histogram_gaussian"] = f"""{_BINS}
SELECT bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, round(center, 6) AS center,
  CAST(floor(exp(-0.5 * ((center - mean) / std) * ((center - mean) / std)) * 100 + 0.5) AS BIGINT) AS frequency FROM bins"""
ORACLES["overview"] = """SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, CAST(8 AS BIGINT) AS numeric_columns,
  CAST(3 AS BIGINT) AS categorical_columns FROM lineitem"""


# --- Semantic types ---------------------------------------------------------
_S = "trim({c}, " + WS + ")"
_WORDS = "CASE WHEN {s} = '' THEN 0 ELSE len(string_split_regex({s}, '[\\s\\x1c-\\x1f\\x85\\xa0]+')) END"
RULES = (
    ("EMAIL", r"regexp_matches({s}, '(?i)^[\w.+-]+@[\w-]+\.[a-z]{{2,}}$')", 0.7),
    ("DATE_STRING", "{t} IS NOT NULL", 0.7),
    ("PHONE_NUMBER", r"regexp_matches({s}, '^\+?[\d\s\-().]{{7,15}}$')", 0.7),
    ("URL", "regexp_matches({s}, '(?i)^https?://')", 0.7),
    ("PERCENTAGE", r"regexp_matches({s}, '%\s*$')", 0.7),
    ("CURRENCY", "left({s}, 1) IN ('$', '£', '€', '₹', '¥')", 0.6),
)


def _matches(c: str, rule: str) -> str:
    return rule.format(s=strip(c), t=as_time(c))


def _share(c: str, rule: str) -> str:
    return f"count(*) FILTER (WHERE {_matches(c, rule)}) / greatest(count({c}), 1)"


_MIX_TEXTS = ("email", "phone_long", "phone", "link", "pct", "money", "cat_low", "brand")
MIX = with_view("semantic_mix")
ORACLES["semantic_ratios"] = MIX + " " + unions(
    f"SELECT '{c}' AS \"column\", '{kind}' AS semantic_type, round({_share(c, rule)}, 6) AS ratio FROM {table}"
    for table, names in (("semantic_mix", _MIX_TEXTS), ("pages", ("url", "html")))
    for c in names
    for kind, rule, _ in RULES
)


def _text_type(table: str, c: str) -> str:
    words = _WORDS.format(s=strip(c))
    branches = " ".join(f"WHEN {_share(c, rule)} > {share} THEN '{kind}'" for kind, rule, share in RULES)
    unique, ratio = f"count(DISTINCT {strip(c)})", f"count(DISTINCT {strip(c)}) / greatest(count(*), 1)"
    return f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'UNKNOWN' {branches}
  WHEN avg({words}) >= 5 OR ({ratio} > 0.5 AND avg({words}) >= 3) THEN 'FREE_TEXT'
  WHEN {unique} < 20 AND {ratio} < 0.1 THEN 'CATEGORICAL_LOW' WHEN {unique} >= 20 AND {ratio} < 0.5 THEN 'CATEGORICAL_HIGH'
  ELSE 'UNKNOWN' END AS semantic_type FROM {table}"""


def _number_type(table: str, c: str, whole: bool) -> str:
    name = c.lower()
    latitude = "lat" in name
    longitude = "lon" in name or "lng" in name
    money = any(t in name for t in ("price", "cost", "salary", "revenue", "fee"))
    identity = f"WHEN count(DISTINCT {c}) = count(*) THEN 'NUMERIC_ID'" if whole else ""
    return f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'UNKNOWN' WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'PERCENTAGE'
  WHEN {latitude} AND min({c}) >= -90 AND max({c}) <= 90 THEN 'LATITUDE' WHEN {longitude} AND min({c}) >= -180 AND max({c}) <= 180 THEN 'LONGITUDE'
  WHEN {money} THEN 'CURRENCY' {identity} ELSE 'NUMERIC_CONTINUOUS' END AS semantic_type FROM {table}"""


def _date_type(table: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'UNKNOWN' ELSE 'DATE_STRING' END AS semantic_type FROM {table}"


EVENT_TYPES = [
    _number_type("events", "event_id", True), _date_type("events", "ts"), _number_type("events", "user_id", True),
    _text_type("events", "event_type"), _number_type("events", "value", False), _text_type("events", "props"),
]
ORACLES["semantic_types"] = MIX + " " + unions(
    [_number_type("semantic_mix", "id", True)]
    + [_text_type("semantic_mix", c) for c in _MIX_TEXTS]
    + [_number_type("semantic_mix", c, False) for c in ("ratio", "lat", "price")]
    + [_number_type("documents", c, True) for c in ("doc_id", "n_chars")]
    + [_text_type("documents", c) for c in ("text", "lang", "source")]
    + [_number_type("pages", "page_id", True)]
    + [_text_type("pages", c) for c in ("url", "html")]
    + EVENT_TYPES
    + [_number_type("conversations", c, True) for c in ("conv_id", "turn")]
    + [_text_type("conversations", c) for c in ("role", "text")]
)


# --- Profile ----------------------------------------------------------------
def _first_values(table: str, c: str, key: str) -> str:
    return f"""(SELECT string_agg(x, '|' ORDER BY k, x) FROM (SELECT CAST({c} AS VARCHAR) AS x, min({key}) AS k FROM {table}
  WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k, x LIMIT 5))"""


def _profile(table: str, c: str, dtype: str, kind: str, semantic: str, key: str) -> str:
    numeric, date = kind == "numeric", kind == "date"
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in _BLOCK.split(", ")[:-1]) + ", CAST(NULL AS BIGINT) AS outlier_count"
    block = f"(SELECT {_BLOCK} FROM ({_numeric(table, c)}))" if numeric else f"(SELECT {nulls})"
    return f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, missing_count, missing_percent, distinct_count, false AS distinct_count_estimated,
  {numeric} AS is_numeric, {date} AS is_datetime, {not numeric and not date} OR distinct_count <= 50 AS is_categorical,
  (SELECT semantic_type FROM ({semantic})) AS semantic_type, b.*, {_first_values(table, c, key)} AS sample_values
FROM (SELECT count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / greatest(count(*), 1), 4) AS missing_percent,
  count(DISTINCT {c}) AS distinct_count FROM {table}) m, {block} b"""


_EVENTS = (
    ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "date"), ("user_id", "bigint", "numeric"),
    ("event_type", "string", "text"), ("value", "double", "numeric"), ("props", "string", "text"),
)
ORACLES["profile_table"] = unions(
    _profile("events", c, dtype, kind, semantic, "event_id") for (c, dtype, kind), semantic in zip(_EVENTS, EVENT_TYPES)
)

# --- Outliers ---------------------------------------------------------------
def _limits(table: str, c: str, k: float = 1.5) -> str:
    return f"(SELECT q1 - {k} * (q3 - q1) AS low, q3 + {k} * (q3 - q1) AS high FROM (SELECT {_quartiles(f'CAST({c} AS DOUBLE)')} FROM {table}))"


def _out(table: str, c: str, k: float = 1.5) -> str:
    return f"({c} < (SELECT low FROM {_limits(table, c, k)}) OR {c} > (SELECT high FROM {_limits(table, c, k)}))"


ORACLES["outlier_bounds"] = unions(
    f"SELECT '{c}' AS \"column\", round(low, 6) AS lower_bound, round(high, 6) AS upper_bound FROM {_limits(t, c)}"
    for t, c in [("events", c) for c in NUMERIC["events"]] + [("documents", "doc_id"), ("documents", "n_chars")]
)
ORACLES["outlier_detect"] = unions(
    f"SELECT '{c}' AS \"column\", event_id AS row_id, CAST({c} AS DOUBLE) AS value FROM events WHERE {_out('events', c)}" for c in ("user_id", "value")
)
_ANY = " OR ".join(_out("events", c) for c in NUMERIC["events"])
ORACLES["outlier_rows"] = f"""SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {_out('events', c)} THEN '{c}' END" for c in NUMERIC['events'])}) AS outlier_columns
FROM events WHERE {_ANY}"""
ORACLES["outlier_rows_of_column"] = f"SELECT * FROM events WHERE {_out('events', 'value')}"
ORACLES["outlier_remove_any"] = f"SELECT * FROM events WHERE NOT ({_ANY})"
ORACLES["outlier_remove_selected"] = f"SELECT doc_id, n_chars FROM documents WHERE NOT {_out('documents', 'n_chars')}"
ORACLES["outlier_removal_counts"] = f"""SELECT count(*) FILTER (WHERE {_out('events', 'value')}) AS rows_removed, count(*) AS original_rows,
  count(*) FILTER (WHERE NOT {_out('events', 'value')}) AS cleaned_rows FROM events"""


def _summary(table: str, c: str, key: str) -> str:
    first = f"(SELECT {c} AS v, {key} AS k FROM {table} WHERE {_out(table, c)} ORDER BY {key} LIMIT 5)"
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {_out(table, c)}) AS outlier_count, count(*) AS total_count,
  round(count(*) FILTER (WHERE {_out(table, c)}) / count(*) * 100, 2) AS percentage,
  (SELECT coalesce(string_agg(CAST(CAST(v AS DOUBLE) AS VARCHAR), '|' ORDER BY k), '') FROM {first}) AS sample_values,
  (SELECT coalesce(string_agg(CAST(k AS VARCHAR), '|' ORDER BY k), '') FROM {first}) AS sample_indices FROM {table}"""


ORACLES["outlier_summary"] = unions(
    [_summary("events", "user_id", "event_id"), _summary("events", "value", "event_id"), _summary("documents", "n_chars", "doc_id")]
)
ORACLES["outlier_threshold_3"] = f"SELECT * FROM events WHERE NOT {_out('events', 'value', 3.0)}"

# --- Validation -------------------------------------------------------------
def _issue(column: str, message: str, source: str, holds: str) -> str:
    return f"SELECT '{column}' AS \"column\", {message} AS issue FROM (SELECT * FROM {source}) WHERE {holds}"


def _nulls(c: str) -> str:
    return _issue(
        c, "concat('missing values found (required field has ', n, ' nulls)')",
        f"(SELECT count(*) - count({c}) AS n FROM clean_customer)", "n > 0",
    )


def _beyond(table: str, c: str, limit, low: bool) -> str:
    agg, words, op = ("min", "is below minimum", "<") if low else ("max", "exceeds maximum", ">")
    return _issue(c, f"concat('value ', x, ' {words} {limit}')", f"(SELECT {agg}({c}) AS x FROM {table})", f"x {op} {limit}")


ORACLES["validate_spec"] = CUSTOMER + " " + unions(
    [
        _nulls("num_a"), _beyond("clean_customer", "num_a", 150, False), _nulls("seg"),
        "SELECT 'seg', 'expected numeric type, found string'", _beyond("clean_customer", "bal", 0, True),
        _beyond("clean_customer", "bal", 5000, False), "SELECT 'c_custkey', 'expected datetime type, found bigint'",
        "SELECT 'discount', 'column not found in dataset'",
    ]
)
ORACLES["validate_required"] = CUSTOMER + " " + unions(_nulls(c) for c in ("c_custkey", "num_a", "seg", "bal", "allnull"))
ORACLES["validate_range"] = unions(
    [
        _beyond("lineitem", "l_quantity", 5, True), _beyond("lineitem", "l_quantity", 45, False), _beyond("lineitem", "l_tax", 0, True),
        _beyond("lineitem", "l_tax", 1, False), _beyond("lineitem", "l_discount", 0.05, False),
    ]
)
ORACLES["validate_types"] = """SELECT 'event_id' AS "column", 'expected string type, found bigint' AS issue FROM (SELECT count(*) FROM events)
UNION ALL SELECT 'value', 'expected boolean type, found double' UNION ALL SELECT 'props', 'expected datetime type, found string'"""
ORACLES["validate_table"] = ORACLES["duplicate_names"]

# --- Outputs ----------------------------------------------------------------
_CELL = r"substring(regexp_replace(concat(text, chr(7), chr(11), ' end', text), '[\x00-\x08\x0B-\x0C\x0E-\x1F]', '', 'g'), 1, 32767)"
ORACLES["spreadsheet_cells"] = f"SELECT doc_id, length(cell) AS length, md5(cell) AS text_md5 FROM (SELECT doc_id, {_CELL} AS cell FROM documents)"
ORACLES["spreadsheet_table"] = f"""{with_view('odd_numbers')}
SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS v, concat('{{"k":', o_orderkey, ',"t":"a\\u0001b"}}') AS pair FROM odd_numbers"""
ORACLES["json_rows"] = f"{with_view('odd_numbers')} SELECT o_orderkey, coalesce(isfinite(v), false) AS has_value, true AS is_plain FROM odd_numbers"
ORACLES["csv_roundtrip"] = "SELECT doc_id, n_chars, lang, source, md5(text) AS text_md5 FROM documents"
ORACLES["csv_row_order"] = """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id, o_orderkey, o_orderpriority || chr(10) || '"x",' AS clerk FROM orders"""
ORACLES["parquet_roundtrip"] = f"{with_view('dirty_customer')} SELECT * FROM dirty_customer"
ORACLES["encoding_fallback"] = "SELECT c_custkey, c_name || ' café' AS label, 'latin-1' AS encoding FROM customer"
ORACLES["load_metadata"] = "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, 'utf-8' AS encoding FROM orders"

# --- Runs -------------------------------------------------------------------
_RUN = f"""{CUSTOMER} SELECT c_custkey, coalesce(CAST(num_a AS DOUBLE), (SELECT quantile_cont(num_a, 0.5) FROM clean_customer)) AS num_a,
  coalesce(seg, {_MODE.format(c='seg')}) AS seg, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM clean_customer)), 6) AS bal FROM clean_customer"""
ORACLES["clean_run"] = _RUN
ORACLES["clean_run_csv"] = _RUN
ORACLES["clean_run_spec"] = f"""{STANDARD}, found AS (SELECT p_partkey, gb, {extracted('mass', r'(\d+\.?\d*)\s*kg')} AS w, {number('cost')} AS p, brand FROM standard)
SELECT p_partkey, round(coalesce(gb, (SELECT avg(gb) FROM found)), 6) AS "Capacity", w AS "Heft", brand AS "BRAND" FROM found"""
ORACLES["clean_run_outliers"] = ORACLES["outlier_remove_any"]
ORACLES["run_summary"] = f"""{CUSTOMER} SELECT count(*) AS rows_before, count(*) AS rows_after, CAST(5 AS BIGINT) AS columns_before, CAST(4 AS BIGINT) AS columns_after,
  CAST(0 AS BIGINT) AS duplicates_removed, 'allnull' AS columns_dropped, 3 * count(*) - count(num_a) - count(seg) - count(bal) AS missing_filled_total,
  count(*) - count(seg) AS seg_missing_before, CAST(0 AS BIGINT) AS seg_missing_after FROM clean_customer"""
# A text column declared numeric converts first; without any number in it, it is dropped.
ORACLES["run_issues"] = f"""{CUSTOMER} SELECT 'num_a' AS "column", concat('value ', CAST(max(num_a) AS DOUBLE), ' exceeds maximum 150') AS issue FROM clean_customer HAVING max(num_a) > 150
UNION ALL SELECT 'seg', 'column not found in dataset' FROM clean_customer HAVING count({number('seg')}) = 0
UNION ALL {_beyond('clean_customer', 'bal', 0, True)} UNION ALL {_beyond('clean_customer', 'bal', 5000, False)}
UNION ALL SELECT 'allnull', 'column not found in dataset' UNION ALL SELECT 'c_custkey', 'expected datetime type, found bigint'
UNION ALL SELECT 'discount', 'column not found in dataset'"""
ORACLES["lineage_counts"] = f"""{with_view('dup_orders')}
SELECT 'file_loaded' AS action, count(*) AS affected_count FROM dup_orders
UNION ALL SELECT 'types_converted', 0 UNION ALL SELECT 'columns_dropped', 0
UNION ALL SELECT 'rows_dropped', (SELECT count(*) FROM dup_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders))
UNION ALL SELECT 'nulls_imputed', 0 UNION ALL SELECT 'outliers_removed', 0 UNION ALL SELECT 'columns_renamed', 0"""
ORACLES["steps_run"] = f"""{CUSTOMER}, deduped AS (SELECT * FROM clean_customer QUALIFY row_number() OVER (PARTITION BY num_a ORDER BY c_custkey) = 1),
filled AS (SELECT c_custkey AS _row_id, coalesce(CAST(num_a AS DOUBLE), (SELECT avg(num_a) FROM deduped)) AS num_a, seg,
  coalesce(bal, (SELECT avg(bal) FROM deduped)) AS bal FROM deduped)
SELECT _row_id, round(num_a, 6) AS num_a, seg, round(bal, 6) AS bal FROM filled
WHERE NOT ({_out('filled', 'num_a', 0.5)} OR {_out('filled', 'bal', 0.5)})"""
ORACLES["steps_report"] = f"""WITH kept AS (SELECT DISTINCT * FROM (SELECT o_custkey % 50 AS k, o_orderstatus, o_orderpriority FROM orders))
SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after, (SELECT count(*) FROM orders) - count(*) AS duplicates_removed,
  CAST(0 AS BIGINT) AS outliers_removed, 'file_loaded,rows_dropped,outliers_removed' AS actions FROM kept"""

# --- Any size ---------------------------------------------------------------
_LINES = (("id", "bigint", "numeric"), ("l_orderkey", "bigint", "numeric"), ("l_returnflag", "string", "text"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"))
ORACLES["profile_large"] = (
    "WITH lines AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey, l_returnflag, l_quantity, l_extendedprice FROM lineitem) "
    + unions(_profile("lines", c, dtype, kind, "SELECT 'UNKNOWN' AS semantic_type", "id") for c, dtype, kind in _LINES)
)
ORACLES["distinct_estimated"] = f'SELECT "column", distinct_count, true AS within_error FROM ({ORACLES["distinct_exact"]})'
ORACLES["distinct_decimal"] = """SELECT 'wide' AS "column", count(DISTINCT l_linenumber) AS distinct_count FROM lineitem
UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem"""
ORACLES["quantiles_extreme"] = f"""{with_view('odd_numbers')}, s AS (SELECT list(v ORDER BY v) AS x FROM odd_numbers WHERE v IS NOT NULL AND NOT isnan(v)),
p AS (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS p, unnest(range(5)) AS place),
q AS (SELECT place, x[CAST(floor(pos) AS INTEGER) + 1] AS b, x[CAST(ceil(pos) AS INTEGER) + 1] AS a, pos - floor(pos) AS f
  FROM (SELECT place, x, (len(x) - 1) * CAST(p AS DOUBLE) AS pos FROM s, p)),
r AS (SELECT place, CASE WHEN a = b OR f = 0 THEN b ELSE b * (1 - f) + a * f END AS v FROM q)
SELECT CAST(place AS INTEGER) AS place, CASE WHEN v = CAST('inf' AS DOUBLE) THEN 'inf' WHEN v = CAST('-inf' AS DOUBLE) THEN '-inf' ELSE format('{{:.4f}}', v) END AS quantile FROM r"""
ORACLES["datetime_formats"] = """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE day(o_orderdate) > 12 OR o_orderkey % 8 <> 6"""
ORACLES["outlier_remove_reindexed"] = f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row_id, event_id FROM events WHERE NOT {_out('events', 'value')}"""
ORACLES["outlier_totals"] = """SELECT count(*) AS total_rows, CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS BIGINT) AS total_columns,
  CAST((SELECT count(*) FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')) AS BIGINT) AS numeric_columns_analyzed FROM lineitem"""
ORACLES["validate_failures"] = """SELECT ' ' AS "column", 'column 1 has no name' AS issue FROM (SELECT count(*) FROM customer)
UNION ALL SELECT 'allnull', 'no cell has a value' UNION ALL SELECT '*', 'table without rows'"""
ORACLES["csv_mixed_headers"] = "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders"
ORACLES["lineage_json"] = ORACLES["lineage_counts"]
_STARTS = """WITH starts AS (SELECT repeat('<html>', 10) || substring(html, 1, 3) AS start, html FROM pages)"""
ORACLES["value_counts_text"] = f"""{_STARTS} SELECT "column", rank, md5(value) AS value_md5, "count", unique_count FROM ({_top('starts', 'start', 7)} UNION ALL {_top('starts', 'html', 7)})"""
ORACLES["impute_decimal_mode"] = """WITH prices AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(CAST(p_size AS DECIMAL(24, 2)) + CAST('12345678901234567890.25' AS DECIMAL(24, 2)) AS DECIMAL(24, 2)) END AS price FROM part)
SELECT p_partkey, CAST(coalesce(price, (SELECT price FROM prices WHERE price IS NOT NULL GROUP BY price ORDER BY count(*) DESC, price LIMIT 1)) AS VARCHAR) AS price FROM prices"""

REST = with_view("semantic_rest")
ORACLES["semantic_rest"] = REST + " " + unions(
    [_text_type("semantic_rest", c) for c in ("nothing", "day_text", "code", "remark")] + [_number_type("semantic_rest", "lng_deg", False)]
    + ["""SELECT 'parts' AS "column", 'UNKNOWN' AS semantic_type FROM (SELECT count(*) FROM semantic_rest)"""]
)
ORACLES["spreadsheet_cut_cells"] = "SELECT CAST(doc_id AS VARCHAR) AS name, least(length(c), 500) AS number FROM (SELECT doc_id, {} AS c FROM documents)\nUNION ALL ".format(
    r"regexp_replace(text, '[\x00-\x08\x0B-\x0C\x0E-\x1F]', '', 'g')"
) + unions(rf"SELECT '{c}', count(*) FILTER (WHERE length(regexp_replace({c}, '[\x00-\x08\x0B-\x0C\x0E-\x1F]', '', 'g')) > 500) FROM documents" for c in ("text", "lang", "source"))
ORACLES["timestamp_texts"] = """SELECT o_orderkey, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') AS at, t AS clock
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 3723004005 MICROSECONDS AS t FROM orders)"""
ORACLES["spec_file_run"] = ORACLES["clean_run_spec"]
ORACLES["rules_from_settings"] = f"""{CUSTOMER} SELECT c_custkey, coalesce(num_a, -1) AS num_a, coalesce(seg, 'OTHER') AS seg, coalesce(bal, -1) AS bal FROM clean_customer"""
ORACLES["outlier_free_csv"] = f"""SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM events WHERE NOT ({_ANY})"""
ORACLES["csv_rejections"] = """SELECT 'good' AS "case", CAST(count(*) AS VARCHAR) AS outcome FROM nation UNION ALL SELECT 'header only', 'A header but no rows' UNION ALL SELECT 'no values', 'Not one cell with a value'
UNION ALL SELECT 'blank lines', 'No header' UNION ALL SELECT 'open quote', 'No CSV' UNION ALL SELECT 'absent', 'There is nothing to read'"""
_MESSY = f"""{with_view('messy_orders')}, kept AS (SELECT DISTINCT CAST(qty AS BIGINT) AS qty, amount, st, state FROM messy_orders),
filled AS (SELECT qty, coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM kept)) AS amount FROM kept)"""
ORACLES["lineage_every_count"] = f"""{_MESSY}
SELECT 'file_loaded' AS action, count(*) AS affected_count FROM messy_orders
UNION ALL SELECT 'types_converted', count(qty) FROM messy_orders UNION ALL SELECT 'columns_dropped', 1
UNION ALL SELECT 'rows_dropped', (SELECT count(*) FROM messy_orders) - (SELECT count(*) FROM kept)
UNION ALL SELECT 'nulls_imputed', count(*) - count(amount) FROM kept
UNION ALL SELECT 'outliers_removed', count(*) FROM filled WHERE {_out('filled', 'qty')} OR {_out('filled', 'amount')}
UNION ALL SELECT 'columns_renamed', 1"""
_DONE = f"""{CUSTOMER}, done AS (SELECT c_custkey, coalesce(CAST(num_a AS DOUBLE), (SELECT quantile_cont(num_a, 0.5) FROM clean_customer)) AS num_a,
  coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM clean_customer)) AS bal FROM clean_customer), gaps AS (
  SELECT count(*) AS n, count(*) - count(num_a) AS num_a, count(*) - count({number('seg')}) AS seg, count(*) - count(bal) AS bal, 0 AS c_custkey, count(*) AS allnull FROM clean_customer)"""


def _profiled(c: str, dtype: str) -> str:
    names = ("min", "max", "q1", "median", "q3")
    cells = " || '|' || ".join(f'CAST("{n}" AS VARCHAR)' for n in names)
    return f"""SELECT 'profile' AS section, '{c}' AS name, '{dtype}|0|' || (SELECT count(DISTINCT {c}) FROM done) || '|true|' || (SELECT count(DISTINCT {c}) <= 50 FROM done) || '|' || {cells} || '|' || outlier_count AS value
FROM ({_numeric('done', c)})"""


def _entries(section: str, values: dict[str, str], table: str) -> list[str]:
    return [f"SELECT '{section}' AS section, '{name}' AS name, CAST({value} AS VARCHAR) AS value FROM {table}" for name, value in values.items()]


ORACLES["report_json"] = _DONE + " " + unions(
    _entries("summary", {
        "rows_before": "n", "rows_after": "n", "columns_before": "5", "columns_after": "3", "duplicates_removed": "0", "outliers_removed": "0",
        "missing_filled_total": "num_a + bal", "converted_total": f"(SELECT count({number('seg')}) FROM clean_customer)",
    }, "gaps")
    + _entries("missing_before", {c: c for c in ("c_custkey", "num_a", "seg", "bal", "allnull")}, "gaps")
    + _entries("missing_after", {c: "0" for c in ("c_custkey", "num_a", "bal")}, "gaps")
    + _entries("missing_filled_per_column", {c: c for c in ("num_a", "bal")}, "gaps")
    + [f"SELECT 'semantic_types', \"column\", semantic_type FROM ({_number_type('done', c, c == 'c_custkey')})" for c in ("c_custkey", "num_a", "bal")]
    + [_profiled("c_custkey", "bigint"), _profiled("num_a", "double"), _profiled("bal", "double")]
    + _entries("lineage", {"file_loaded": "n", "types_converted": f"(SELECT count({number('seg')}) FROM clean_customer)", "columns_dropped": "2", "rows_dropped": "0", "nulls_imputed": "num_a + bal", "outliers_removed": "0", "columns_renamed": "0"}, "gaps")
    + [f"SELECT 'issues', \"column\", issue FROM ({ORACLES['run_issues']})"]
    + [f"SELECT 'mapping', '{c}', '{c}|exact' FROM gaps" for c in ("c_custkey", "num_a", "seg", "bal", "allnull")]
    + ["SELECT 'samples', 'sizes', '10|10' FROM gaps"]
)
