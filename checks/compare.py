"""Run queries next to their SQL: ``python -m checks.compare [sf_dir] [query ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from .oracles import ORACLES
from .queries import QUERIES


def session(cpus: str = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    got = normal(df.columns, df.collect())
    if name not in ORACLES:
        return True, f"{len(got[1])} rows, no SQL"
    cursor = con.execute(ORACLES[name])
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, f"columns {got[0]} / {want[0]}"
    only = [r for r in got[1] if r not in set(want[1])][:3], [r for r in want[1] if r not in set(got[1])][:3]
    return False, f"{len(got[1])} / {len(want[1])} rows\n   spark {only[0]}\n   sql   {only[1]}"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = session(), duck(sf_dir), 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, "".join(traceback.format_exception(e))[-1500:]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} of {len(argv[1:] or QUERIES)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
