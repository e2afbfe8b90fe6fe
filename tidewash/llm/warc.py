"""WARC archives: deduplicated writing with revisit records, and reading back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .common import numbered, staged

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
#: Payload bytes that one archive file is meant to hold, before compression.
FILE_BYTES = 32 << 20


def payload_digest(payload: Column) -> Column:
    """SHA-1 of the payload in base32: eight characters for each ten hex digits."""
    digits, base32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), digits, base32)


def originals(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``digest, bytes, original, copies`` of ``order, digest, bytes`` headers.

    Headers alone are shuffled by payload digest and length; the record that comes first in
    ``order`` is the original of its group. A digest with a third of all records is one header
    per task before it is sent. Payloads under ``min_bytes`` form no groups.
    """
    grouped = F.when(F.col("bytes") >= min_bytes, F.col("order"))
    return records.groupBy("digest", "bytes").agg(F.min(grouped).alias("original"), F.count("*").alias("copies"))


def _record_id(order: Column) -> Column:
    name = F.md5(F.concat_ws(" ", order["none"].cast("string"), F.coalesce(order["key"].cast("string"), F.lit("")), order["file"].cast("string"), order["row"].cast("string")))
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Line breaks in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str | None = None, key_column: str = "page_id", uri_column: str = "url", payload_column: str = "html",
                   min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> str:
    """Writes one WARC record per page to ``path`` (default: the shared folder), which is returned.

    Of records with equal payloads (null counts as empty, text is UTF-8) the one with the
    smallest key is a response, the others revisit it without a body; null keys come last, and
    among rows with one key their place in the input decides. Every record gets fresh headers.
    Files are gzip-compressed, hold about ``file_bytes`` of payload, and each stands alone.
    """
    page = F.col("doc")
    payload = F.coalesce(page[payload_column].cast("binary"), F.lit(b"").cast("binary"))
    records = numbered(pages).select(
        F.struct(page[key_column].isNull().alias("none"), page[key_column].alias("key"), "file", "row").alias("order"), page[uri_column].alias("uri"), payload.alias("payload"),
    ).withColumn("digest", payload_digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    headers = staged(originals(records.select("order", "digest", "bytes"), min_bytes))
    # Hashed, not sorted: payloads are streamed past the headers.
    records = records.join(headers.drop("copies").hint("shuffle_hash"), ["digest", "bytes"])
    response = F.coalesce(F.col("order") == F.col("original"), F.lit(True))
    http = F.concat(F.lit(f"{HTTP_OK}Content-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(response, F.concat(http.cast("binary"), F.col("payload"))).otherwise(F.lit(b"").cast("binary"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(response, "response").otherwise("revisit")), _line("WARC-Record-ID", _record_id(F.col("order"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("uri")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(~response, F.lit(PROFILE))), _line("WARC-Refers-To", F.when(~response, _record_id(F.col("original")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("X-Page-Key", F.col("order.key")),
        _line("Content-Length", F.octet_length(body)), F.lit("\r\n"),
    )
    path = path or shared_folder(pages.sparkSession)
    mean = headers.agg(F.sum(F.col("bytes") * F.col("copies")) / F.sum("copies")).first()[0] or 0
    per_file = max(1, int(file_bytes / (mean + 1024)))
    # Bytes pass through a string column unchanged, and the blank lines after a record are the line separator.
    text = records.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one archive file."""
    data, at = b"", 0

    def more() -> bool:
        nonlocal data, at
        chunk = next(chunks, None)
        if chunk is not None:
            data, at = data[at:] + chunk, 0
        return chunk is not None

    while True:
        while at < len(data) or more():
            if data[at] not in b"\r\n":
                break
            at += 1
        else:
            return
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("WARC file ends inside a header")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, size = end + 4, int(headers["content-length"])
        if size > len(data) - at:
            got = [data[at:]]
            while sum(map(len, got)) < size:
                got.append(next(chunks, None))
                if got[-1] is None:
                    raise ValueError("WARC file ends inside a record")
            data, at = b"".join(got), 0
        yield headers, data[at : at + size]
        at += size


def _unzipped(content: bytes, chunk: int = 4 << 20) -> Iterator[bytes]:
    """The file's bytes in chunks; gzip files may have several members."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + chunk] for i in range(0, len(content), chunk))
        return
    while content:
        member = zlib.decompressobj(31)
        while not member.eof:
            data = member.decompress(content, chunk)
            content = member.unconsumed_tail or member.unused_data
            if data:
                yield data
            elif not member.eof and not content:
                raise ValueError("gzip file ends early")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archive files under ``path``: ``record_type, record_id, refers_to,
    uri, key, header_digest, payload`` (of responses: the HTTP body) with ``payload_bytes`` and
    ``payload_digest``, both taken from the payload itself; null for revisits."""
    names = ["record_type", "record_id", "refers_to", "uri", "key", "header_digest", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.string()] * 6 + [pa.binary(), pa.int64(), pa.string()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in _parse(_unzipped(content.as_py())):
                    payload = None
                    if h.get("warc-type") == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                    rows.append((
                        h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("x-page-key"),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload, None if payload is None else len(payload),
                        None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    ))
                    held += len(block)
                    if held > 4 << 20 or len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(records, "record_type string, record_id string, refers_to string, uri string, key string, header_digest string, payload binary, payload_bytes long, payload_digest string")


def resolved(records: DataFrame) -> DataFrame:
    """Read records with every revisit joined to the response it refers to: ``payload_bytes`` and
    ``payload_digest`` are then those of the full payload, ``refers_to_key`` is the response's key
    (null for responses). A revisit whose response is missing keeps nulls there."""
    light = records.select("record_type", "record_id", "refers_to", "uri", "key", "payload_bytes", "payload_digest")
    responses = light.where("record_type = 'response'")
    originals = responses.select(F.col("record_id").alias("refers_to"), F.col("key").alias("refers_to_key"), "payload_bytes", "payload_digest")
    revisits = light.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(originals, "refers_to", "left")
    columns = ["key", "uri", "record_type", "record_id", "refers_to", "refers_to_key", "payload_bytes", "payload_digest"]
    return responses.withColumn("refers_to_key", F.lit(None).cast("string")).select(columns).union(revisits.select(columns))
