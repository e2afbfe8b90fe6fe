import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewash.operators.columns import dense_row_id, first_rows
from tidewash.operators.conversion import convert_types
from tidewash.sinks import iso_timestamps, json_safe, spreadsheet_safe, write_csv, write_json
from tidewash.sources import LoadError, list_specs, load_spec, parse_specs, read_csv, read_table, stage_table
from tidewash.sources.specs import default_spec


def put(tmp_path, data, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(table):
    return [tuple(r)[1:] for r in table.df.orderBy("_row_id").collect()]


def test_plain_file(spark, tmp_path):
    table = read_csv(spark, put(tmp_path, "a,b\n1,2\n3,4\n"))
    assert tuple(table.metadata().first()) == (2, 2, "utf-8") and rows(table) == [("1", "2"), ("3", "4")]
    assert dict(convert_types(table.df, read_types=True).dtypes) == {"_row_id": "bigint", "a": "bigint", "b": "bigint"}


def test_quoted_newlines_and_missing_cells(spark, tmp_path):
    text = 'a,b\n"x\ny","say ""hi"", ok"\nNA,  \nnone,<NA>\n'
    assert rows(read_csv(spark, put(tmp_path, text))) == [("x\ny", 'say "hi", ok'), (None, None), ("none", None)]


def test_header_repair(spark, tmp_path):
    table = read_csv(spark, put(tmp_path, "﻿a,b,a,,a\n1,2,3,4,5\n"))
    assert table.df.columns == ["_row_id", "a", "b", "a.1", "Unnamed: 3", "a.2"]


def test_encodings(spark, tmp_path):
    path = put(tmp_path, "a,b\n1,café\n".encode("latin-1"))
    table = read_csv(spark, path)
    assert table.encoding == "latin-1" and rows(table) == [("1", "café")]
    with pytest.raises(LoadError, match="no text"):
        read_csv(spark, path, encodings=["utf-8"])
    legal = put(tmp_path, "a\ncafé �\n", "b.csv")  # the replacement character itself is valid
    assert read_csv(spark, legal).encoding == "utf-8"


def test_files_of_both_kinds_in_one_folder(spark, tmp_path):
    folder = tmp_path / "both"
    folder.mkdir()
    put(folder, "a,b\n1,café\n".encode("latin-1"), "1.csv")
    put(folder, 'a,b\n2,"thé\nvert"\n', "2.csv")
    table = read_csv(spark, str(folder))
    assert set(rows(table)) == {("1", "café"), ("2", "thé\nvert")} and table.encodings == ("utf-8", "latin-1")


def test_columns_meet_by_name(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder, "x,y\n10,20\n", "a.csv")
    put(folder, "y,x\r\n2,1\r\n", "b.csv")
    put(folder, "x,y\n30,40\n", "c.csv")
    for options in ({}, {"encodings": ["utf-8"], "multi_line": False}):
        got = read_csv(spark, str(folder), **options).df.select("x", "y").collect()
        assert sorted(map(tuple, got)) == [("1", "2"), ("10", "20"), ("30", "40")]
    put(folder, "x,z\n1,2\n", "d.csv")
    with pytest.raises(LoadError, match="another"):
        read_csv(spark, str(folder))


def test_rejections(spark, tmp_path):
    for data, message in ((b"", "empty"), (b'"', "never ends"), (b"a,b\n", "no rows"), (b"a,b\n,NA\n , \n", "one cell")):
        with pytest.raises(LoadError, match=message):
            read_csv(spark, put(tmp_path, data, f"{message[:4]}.csv"))
    with pytest.raises(LoadError, match="nothing to read"):
        read_csv(spark, str(tmp_path / "absent.csv"))
    assert rows(read_csv(spark, put(tmp_path, 'size\n5" pipe\n', "inch.csv"))) == [('5" pipe',)]


def test_short_rows_are_filled_and_long_rows_stop(spark, tmp_path):
    assert rows(read_csv(spark, put(tmp_path, "a,b\n1\n2,3\n", "short.csv"))) == [("1", None), ("2", "3")]
    with pytest.raises(LoadError, match="more cells"):
        read_csv(spark, put(tmp_path, "a,b\n1,2,3\n", "long.csv"))
    late = read_csv(spark, put(tmp_path, "a,b\n" + "1,2\n" * 50 + "1,2,3\n", "late.csv"))
    with pytest.raises(Exception, match="more cells"):
        late.df.select("b").collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"uote', [1.0]), (2, "new\nline, comma", None), (3, None, None)], "k long, s string, a array<double>")
    write_csv(df, str(tmp_path / "out"))
    got = read_csv(spark, str(tmp_path / "out")).df
    assert {(r["k"], r["s"], r["a"]) for r in got.collect()} == {("1", 'q"uote', "[1.0]"), ("2", "new\nline, comma", None), ("3", None, None)}


def test_json_has_no_special_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [float("inf"), 1.0], {"k": float("nan")}, (float("-inf"), "t"))], "k long, v double, a array<double>, m map<string,double>, s struct<x:double,t:string>")
    write_json(df.withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"k": 1, "v": None, "a": [None, 1.0], "m": {"k": None}, "s": {"x": None, "t": "t"}, "at": "2024-01-02T03:04:05.000000"}
    assert json_safe(df).select("k").first()[0] == 1 and iso_timestamps(df).columns == df.columns


def test_spreadsheet_safe(spark):
    df = spark.sql("SELECT 1 AS n, double('inf') AS v, 'a\\u0007b' AS s, timestamp'2024-01-02 03:04:05' AS t, named_struct('x', double('nan'), 'y', 'z') AS o, true AS b")
    assert tuple(spreadsheet_safe(df).first()) == (1, None, "ab", datetime(2024, 1, 2, 3, 4, 5), '{"x":null,"y":"z"}', True)
    assert dict(spreadsheet_safe(df).dtypes)["t"] == "timestamp_ntz"


def test_specs(spark, tmp_path):
    put(tmp_path, json.dumps({"version": "1", "schema": {"fields": {"Ram": {"aliases": ["ram"], "type": "numeric"}}}}), "one.json")
    put(tmp_path, "{bad", "two.json")
    assert list_specs(spark, str(tmp_path)) == ["one.json", "two.json"] and list_specs(spark, str(tmp_path / "no")) == []
    spec = load_spec(spark, str(tmp_path / "one.json"))
    assert spec.resolve("ram") == ("Ram", "alias") and parse_specs(spark, spec).first()["aliases"] == ["ram"]
    with pytest.raises(ValueError, match="holds no spec"):
        load_spec(spark, str(tmp_path / "two.json"))
    with pytest.raises(FileNotFoundError):
        load_spec(spark, str(tmp_path / "none.json"))
    assert default_spec(spark, str(tmp_path)).fields == {} and default_spec(spark, str(tmp_path), "one.json").fields


def test_stage_reads_back_the_same_rows(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    assert sorted(stage_table(df).collect()) == sorted(df.collect())


def test_odd_file_names(spark, tmp_path):
    for i, name in enumerate(("a b.csv", "100% [x].csv", "p+q{1}.csv")):
        folder = tmp_path / f"f{i}"
        folder.mkdir()
        put(folder, "a\n1\n", name)
        assert rows(read_csv(spark, str(folder))) == [("1",)]


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few lines."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_quotes_decide_where_cells_end(spark, tmp_path):
    text = 'id,text\n1,"say ""hi""\nthere"\n2,"abc\n"\n3,"def\n"\n'
    assert rows(read_csv(spark, put(tmp_path, text))) == [("1", 'say "hi"\nthere'), ("2", "abc\n"), ("3", "def\n")]
    text = 'a,b\r\n1,"x\r\n\r\ny"\r\n\r\n5" pipe,6" pipe\r\n2,"q"" , \r\n,"",z\n"\r\n'
    assert rows(read_csv(spark, put(tmp_path, text))) == [("1", "x\r\n\r\ny"), ('5" pipe', '6" pipe'), ("2", 'q" , \r\n,",z\n')]
    with pytest.raises(LoadError, match="never ends in .*open.csv"):
        read_csv(spark, put(tmp_path, 'a,b\n1,"x\n2,""y\n', "open.csv"))


def test_headers_and_line_ends_of_other_kinds(spark, tmp_path):
    assert rows(read_csv(spark, put(tmp_path, "a,b\r1,2\r3,4\r"))) == [("1", "2"), ("3", "4")]
    table = read_csv(spark, put(tmp_path, '"a\nc",b\n1,"2\n3"\n'))
    assert table.df.columns == ["_row_id", "a\nc", "b"] and rows(table) == [("1", "2\n3")]
    table = read_csv(spark, put(tmp_path, "a,b\n1,é\n".encode("utf-16")), encodings=["utf-16"], multi_line=True)
    assert rows(table) == [("1", "é")]


def test_random_cells_over_many_blocks(spark, tmp_path, small_blocks):
    import csv
    import random

    rng = random.Random(11)
    folder = tmp_path / "random"
    folder.mkdir()
    want, tasks = [], 0
    for name, n in (("b.csv", 3), ("c.csv", 400), ("a.csv", 150), ("d.csv", 1)):
        mine = [[f"{name}{i}", *["".join(rng.choice(['"', '""', ",", "\n", "\r\n", "x", "yz ", "é", "5\" "]) for _ in range(rng.randrange(1, 9))) + "." for _ in range(2)]] for i in range(n)]
        with open(folder / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "a.csv" else "\n")
            out.writerow(["k", "s", "t"])
            out.writerows(mine)
        want.append((name, mine))
    table = read_csv(spark, str(folder))
    tasks = table.kept[0].count()
    assert tasks > 100
    assert rows(table) == [tuple(r) for _, mine in sorted(want) for r in mine]
    table.release()


def test_rows_are_numbered_in_the_order_of_the_input(spark, tmp_path, small_blocks):
    folder = tmp_path / "order"
    folder.mkdir()
    want = []
    for name, n in (("a", 3), ("b", 800), ("c", 1), ("d", 40)):
        put(folder, "k\n" + "".join(f"{name}{i}\n\n" for i in range(n)), f"{name}.csv")
        want += [f"{name}{i}" for i in range(n)]
    for size in ("64", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        table = read_csv(spark, str(folder)).df
        got = table.repartition(5).orderBy("_row_id").collect()
        assert [r["k"] for r in got] == want
        assert got[0]["_row_id"] == 1 and got[3]["_row_id"] == 8  # numbers of lines, through all files
        assert [r["k"] for r in first_rows(table, 4)] == want[:4]
        dense = dense_row_id(table.where("k <> 'a1'")).orderBy("_row_id").collect()
        assert [r["_row_id"] for r in dense] == list(range(len(want) - 1))


def test_parquet_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    for name, low, high in (("a", 0, 3), ("b", 3, 5000), ("c", 5000, 5001)):
        spark.range(low, high, numPartitions=1).coalesce(1).write.parquet(str(tmp_path / "t" / f"part={name}"))
    df = read_table(spark, str(tmp_path / "t"), row_id=True)
    assert df.where("_row_id <> id").count() == 0 and df.count() == 5001


def test_a_changed_cut_of_the_files_stops_the_read(spark, tmp_path, small_blocks):
    table = read_csv(spark, put(tmp_path, "a\n" + "1\n" * 500, "long.csv")).df
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    with pytest.raises(Exception, match="split differently"):
        table.select("a").collect()


def test_lines_of_open_cells_are_shuffled_once(spark, tmp_path, small_blocks):
    # Cells of no, one and many line breaks; the long ones fill blocks of their own.
    want = [(str(i), "\n".join(f'line {j}, "{i}"' for j in range(n))) for i, n in enumerate((1, 2, 40, 1, 3, 90, 2, 1))]
    text = "k,t\n" + "".join('{},"{}"\n'.format(k, t.replace('"', '""')) for k, t in want)
    table = read_csv(spark, put(tmp_path, text, "cells.csv"))
    assert rows(table) == want
    assert table.kept[1].where("closed IS NOT NULL").count() > 20
    plan = table.df._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert physical.count("Exchange hashpartitioning(start#") == 1 and "hashpartitioning(record#" not in physical


def test_inspection_sorts_no_lines(spark, tmp_path):
    from tidewash.sources.csv import _inspected, _lines

    blocks, counted = _inspected(_lines(spark, [put(tmp_path, '\n \na,b\n1,"x\n"\n', "few.csv")]))
    assert [(r["header_line"], bytes(r["header"]), r["opens"]) for r in blocks.collect()] == [(2, b"a,b", True)]
    assert "SortAggregate" not in counted._jdf.queryExecution().toString()
    blocks.unpersist(), counted.unpersist()
