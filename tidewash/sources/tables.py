"""Typed tables: cleaned results read again, and staging between expensive steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import ROW_ID
from ..operators.columns import with_file_row_id


def read_table(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """Read a Parquet table; it keeps its types, so nothing is inferred again. ``row_id`` numbers the rows
    in the order of the files' paths."""
    df = spark.read.parquet(path)
    return with_file_row_id(df) if row_id and ROW_ID not in df.columns else df


def shared_folder(spark: SparkSession, base: str | None = None) -> str:
    """A new folder name that every executor reaches.

    It lies under ``base`` if given, else under ``spark.checkpoint.dir``, else under
    ``spark.sql.warehouse.dir``.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidewash-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back.

    Cuts the lineage, survives lost executors, and later statistics read only the
    columns they need.
    """
    path = path or shared_folder(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
