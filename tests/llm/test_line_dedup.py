import random

import pytest
from pyspark.sql import functions as F

from tidewash.llm.common import numbered
from tidewash.llm.line_dedup import dedup_lines, dropped_lines


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] if i < len(b) else True


def plain(docs, min_chars):
    lines = []
    for row, (doc_id, text) in enumerate(docs):
        for pos, line in enumerate((text or "").split("\n")):
            norm = line.strip(" \t\r\v\f").lower()
            if len(norm) >= min_chars:
                lines.append(((doc_id is None, doc_id or 0, row, pos), norm))
    lines.sort()
    gone = {}
    for i, (order, norm) in enumerate(lines):
        if any(near(norm, earlier) for _, earlier in lines[:i]):
            gone.setdefault(order[2], []).append(order[3])
    return {row: sorted(x) for row, x in gone.items()}


def edited(rng, line):
    i, c = rng.randrange(len(line) + 1), rng.choice("abé日 ")
    return rng.choice([line[:i] + c + line[i:], line[:i] + line[i + 1 :], line[:i] + c + line[i + 1 :], line])


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé日 ", k=rng.choice([3, 8, 15, 16, 17, 31, 32, 33, 47, 64, 100, 300]))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = [rng.choice(base) for _ in range(rng.randint(0, 6))]
        lines = [edited(rng, x) if rng.random() < 0.5 else x for x in lines]
        docs.append((rng.choice([i, i // 2, None]), "\n".join(edited(rng, x) if rng.random() < 0.2 else x for x in lines)))
    df = numbered(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    got = {r.row: r.dropped for r in dropped_lines(df, min_chars=8).collect()}
    assert got == plain(docs, 8)


def test_text_without_the_lines(spark):
    docs = [(1, "This line is shared by all.\nfirst\n\nonly here, says the first"), (2, "this line is shared by alL.  \nfirst\n\nsecond"), (3, "This line is shared by ell.\r\nThis line is shared by al.\r"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("dropped", F.lit("x")).coalesce(1)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == {1: docs[0][1], 2: "first\n\nsecond", 3: "", 4: None}
    assert dedup_lines(df).columns == df.columns


def test_long_lines(spark):
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefgh ", k=60_000))
    docs = [(1, line), (2, line[:41_000] + line[41_001:]), (3, line[:5] + "zz" + line[7:])]
    df = numbered(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert {r.row: r.dropped for r in dropped_lines(df).collect()} == {1: [0]}


def test_odd_and_no_rows(odd_docs, no_docs):
    got = {r.doc_id: r.text for r in dedup_lines(odd_docs).where("doc_id IS NOT NULL").collect()}
    assert got[1] and got[2] == "" and got[3] is None and got[4] == ""
    assert dedup_lines(odd_docs).count() == 10 and dedup_lines(no_docs).count() == 0


def test_short_repeats_go_by_equality_alone(spark):
    docs = [(1, "les.\n\nand ornd.\nthe first document of all"), (2, " LES.\n\nand ornd\nles\nanother line, long enough"), (3, "les.\nand ornd.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in dedup_lines(df, exact_chars=1).collect()}
    assert got == {1: docs[0][1], 2: "\nand ornd\nles\nanother line, long enough", 3: ""}
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == dict(docs)


def test_pipeline_stage_drops_short_repeats(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "les.\nx"), (2, "les.\ny")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert got == {1: "les.\nx", 2: "y"}


def test_very_many_repeated_lines_in_one_text(spark):
    import time

    lines = ["the same line of some length"] * 200_000 + ["the end of it all, and nothing else"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    start = time.time()
    assert [r.text for r in dedup_lines(docs).collect()] == ["the same line of some length\nthe end of it all, and nothing else"]
    assert time.time() - start < 60
