import base64
import glob
import gzip
import hashlib

import pytest

from tidewash.llm.warc import _parse, read_archives, resolved, write_archives

PAGES = [
    (5, "http://a/1", "<p>same\r\n\r\nWARC/1.1\r\nbody</p>"), (3, "http://a/2", "<p>same\r\n\r\nWARC/1.1\r\nbody</p>"), (9, "http://a/3", "é日本\n"), (4, None, None),
    (2, "http://a/\r\nX: y", ""), (None, "http://a/5", "only null"), (None, "http://a/6", "<p>same\r\n\r\nWARC/1.1\r\nbody</p>"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "x" * 9_000_000),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS bytes", "'x' AS key").coalesce(3)


@pytest.fixture(scope="module")
def archive(spark, pages, tmp_path_factory):
    return write_archives(pages, str(tmp_path_factory.mktemp("warc") / "out"), file_bytes=4096)


def test_round_trip(spark, archive):
    rows = [(r.key and int(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key and int(r.refers_to_key)) for r in resolved(read_archives(spark, archive)).collect()]
    want = []
    for i, (page, _, html) in enumerate(PAGES):
        order = lambda j: (PAGES[j][0] is None, PAGES[j][0] or 0, j)
        first = min((j for j, p in enumerate(PAGES) if (p[2] or "") == (html or "")), key=order)
        want.append((page, len((html or "").encode()), digest(html), "response" if first == i else "revisit", None if first == i else PAGES[first][0]))
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_payloads_headers_and_small_payloads(spark, pages, archive, tmp_path):
    rows = read_archives(spark, archive).collect()
    assert all(r.header_digest == r.payload_digest for r in rows if r.record_type == "response")
    assert {bytes(r.payload).decode() for r in rows if r.payload is not None} == {h or "" for _, _, h in PAGES}
    assert len({r.record_id for r in rows}) == len(PAGES) and "http://a/ X: y" in {r.uri for r in rows}
    apart = read_archives(spark, write_archives(pages, str(tmp_path / "w"), min_bytes=1000)).collect()
    assert {r.record_type for r in apart} == {"response"}


def test_files_stand_alone(archive):
    found = 0
    for name in glob.glob(f"{archive}/part-*"):
        found += sum(1 for _ in _parse(iter([gzip.open(name).read()])))
    assert found == len(PAGES)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_parser_takes_any_chunks(size):
    data = b"WARC/1.1\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n\r\nWARC/1.1\r\ncontent-length:0\r\nX: a:b\r\n\r\n\r\n\r\n"
    chunks = (data[i : i + size] for i in range(0, len(data), size))
    assert [(h.get("x"), b) for h, b in _parse(chunks)] == [(None, b"a\r\n\r\n"), ("a:b", b"")]


@pytest.mark.parametrize("data", [b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nConte"])
def test_broken_archives_fail(data):
    with pytest.raises(ValueError):
        list(_parse(iter([data])))


def test_no_rows(spark, pages, tmp_path):
    assert resolved(read_archives(spark, write_archives(pages.limit(0), str(tmp_path / "w")))).count() == 0
