import pytest

SF = "/root/testdata/sf0.001"

#: Nulls in every column, empty and long texts, ties, repeated rows.
ODD_DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "b"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (None, "a row without an identifier, and with some words in it", "en", "c"),
    (None, None, None, None),
    (5, "word " * 60_000, "en", "a"),
    (6, "É é ǅ 日本語 İstanbul Σίσυφος ς ½ x² y\x1cz\n\n\tw", "xx", "日"),
    (7, "   \n\t ", "en", "a"),
]
#: Columns named like those the operators make.
CLASHING = "row long, item long, size long, piece int, features string, score double, key string, doc string, _row long, _dropped int, fp long, _metadata string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string, source string").coalesce(2)
    extra = [f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in CLASHING.split(", "))]
    return docs.selectExpr("*", *extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
