"""Messy views of the given tables; one text for both engines.

``{name}`` stands for a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Nulls, missing tokens, padding, a column without values.
    "dirty_customer": """
        SELECT c_custkey,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 200 END AS num_a,
          CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN '  N/A ' WHEN 3 THEN 'null'
               WHEN 4 THEN 'None' WHEN 5 THEN concat('  ', c_mktsegment, ' ') ELSE c_mktsegment END AS seg,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS bal,
          CAST(NULL AS STRING) AS allnull
        FROM {customer}""",
    # Few distinct rows, each with many copies.
    "dup_orders": "SELECT o_custkey % 50 AS k, o_orderstatus, o_orderpriority FROM {orders}",
    "keyed_orders": "SELECT o_orderkey, o_custkey % 50 AS k, o_orderstatus, o_orderpriority FROM {orders}",
    # Units, thousands separators, text that must become null.
    "dirty_part": """
        SELECT p_partkey,
          CASE p_partkey % 5 WHEN 0 THEN concat(p_size, 'GB') WHEN 1 THEN concat(p_size, 'TB HDD')
               WHEN 2 THEN concat(p_size * 1000, 'MB') WHEN 3 THEN concat(p_size, ' GB SSD') ELSE 'unknown' END AS storage,
          concat(p_size, '.5kg') AS mass,
          concat(CAST(floor(p_retailprice) AS INT), ',', lpad(CAST(p_size AS STRING), 3, '0')) AS cost,
          p_brand AS brand
        FROM {part}""",
    # Two formats, garbage, null.
    "dirty_dates": """
        SELECT o_orderkey,
          CASE o_orderkey % 4
            WHEN 0 THEN concat(year(o_orderdate), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
            WHEN 1 THEN concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', year(o_orderdate))
            WHEN 2 THEN 'garbage' ELSE NULL END AS d
        FROM {orders}""",
    # One column per semantic rule.
    "semantic_mix": """
        SELECT p_partkey AS id, concat('user', p_partkey, '@example.com') AS email,
          concat('+1 (555) ', lpad(CAST(p_partkey AS STRING), 7, '0')) AS phone_long,
          concat('555-', lpad(CAST(p_partkey AS STRING), 7, '0')) AS phone,
          concat('https://example.com/', p_partkey) AS link, concat(p_size, '%') AS pct, concat('$', p_size) AS money,
          p_type AS cat_low, p_brand AS brand,
          CAST(p_size AS DOUBLE) / 50 AS ratio, CAST(p_size AS DOUBLE) - 25 AS lat, p_retailprice AS price
        FROM {part}""",
    # What no rule of semantic_mix reaches.
    "semantic_rest": """
        SELECT CAST(NULL AS STRING) AS nothing, concat(year(o_orderdate), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) AS day_text,
          concat('code', o_orderkey) AS code, CAST(o_custkey % 360 AS DOUBLE) - 180.0 AS lng_deg, concat('one two three number', o_orderkey) AS remark
        FROM {orders}""",
    # Every step of a run finds something: text numbers, gaps, an empty column, copies, values far out, one name twice.
    "messy_orders": """
        SELECT CAST(o_custkey % 40 AS STRING) AS qty,
          CASE WHEN o_custkey % 10 = 3 THEN NULL WHEN o_custkey % 97 = 5 THEN 1000000.0 + o_custkey ELSE CAST(o_custkey % 50 AS DOUBLE) END AS amount,
          o_orderstatus AS st, o_orderpriority AS state, CAST(NULL AS STRING) AS gone
        FROM {orders}""",
    # Not-a-number, infinities and null next to plain values.
    "odd_numbers": """
        SELECT o_orderkey,
          CASE o_orderkey % 7 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE)
               WHEN 2 THEN CAST('-Infinity' AS DOUBLE) WHEN 3 THEN NULL ELSE o_totalprice END AS v
        FROM {orders}""",
    # Three columns of one declared field.
    "clashing_part": """
        SELECT p_partkey, concat(p_size, 'GB') AS room, concat(p_size * 2, 'GB') AS disk,
          concat(p_size, 'TB') AS tape, p_brand AS brand
        FROM {part}""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    table = text[text.index("{") + 1 : text.index("}")]
    return spark.sql(text, **{table: base(spark, sf_dir, table)})


def with_view(*names: str) -> str:
    """``WITH`` clause that defines the views over the base tables."""
    parts = []
    for name in names:
        text = VIEWS[name]
        table = text[text.index("{") + 1 : text.index("}")]
        parts.append(f"{name} AS ({text.replace('{' + table + '}', table)})")
    return "WITH " + ",\n".join(parts)
