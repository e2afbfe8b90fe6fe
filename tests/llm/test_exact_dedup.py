import hashlib

from tidewash.llm.exact_dedup import exact_duplicates

from .conftest import ODD_DOCS


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_equal_texts_but_for_ascii_case(odd_docs):
    got = sorted(map(tuple, exact_duplicates(odd_docs, largest=True).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD_DOCS:
        group = [d for d, t, *_ in ODD_DOCS if lower(t) == lower(text)]
        keep = max((d for d in group if d is not None), default=None)
        want.append((doc_id, keep, len(group), doc_id == keep, bytearray(hashlib.sha256(lower(text).encode()).digest())))
    assert got == sorted(want, key=str)


def test_smallest_stays_by_default(spark):
    docs = spark.createDataFrame([(9, "x"), (4, "X"), (5, "y")], "doc_id long, text string")
    assert {r.id: r.keep_id for r in exact_duplicates(docs).collect()} == {9: 4, 4: 4, 5: 5}


def test_one_group_in_many_runs(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', CAST(id AS STRING)) AS text").repartition(40)
    rows = {r.id: r for r in exact_duplicates(docs).collect()}
    assert len(rows) == 5000 and rows[2997].keep_id == 0 and rows[0].group_size == 1667 and rows[1].group_size == 1


def test_no_rows(no_docs):
    assert exact_duplicates(no_docs).count() == 0
