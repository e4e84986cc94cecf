"""Operator 5: WARC archives with revisit records.

Headers are shuffled by payload digest, without the payloads, to find the
response of each digest that more than one record has; the other records of it
become revisits.  Every record is a gzip member of its own, so any record can
be read from its offset.  Archives are written by Spark's own text writer, so
they go to any file system Spark can write, and a lost task leaves no half
file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_FILE = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_id string, page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload_bytes bigint, payload binary"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: ten of them are eight digits to the base of 32, from 0 to V."""
    fifths = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*fifths), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, refers_url for every row of ``pages``.

    Of rows with equal payloads of at least ``min_payload`` bytes, that with
    the smallest page_id is the response; null ids come last, and rows with
    the same smallest id are told apart by url; rows equal in both are each a
    response.  A null html is empty.  Payloads move only where Spark joins
    them with the responses by a shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    first = rows.groupBy("sha").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    size = F.octet_length("html").cast("long")
    revisit = (size >= min_payload) & F.col("first").isNotNull() & (place != F.col("first"))
    return rows.join(first, "sha", "left").select(
        "page_id",
        "url",
        "html",
        size.alias("payload_bytes"),
        base32(F.col("sha")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
    )


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(value, r"[\r\n]", " ")


def record_id(page: Column, url: Column, digest: Column) -> Column:
    """A name of its own for records that differ in page, url or payload."""
    h = F.md5(F.concat_ws("\n", F.coalesce(page.cast("string"), F.lit("none")), digest, F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(resolved: DataFrame, date: str) -> Column:
    """The record of a row: fresh headers, and the payload of a response."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    refers = record_id(F.col("refers_to"), F.col("refers_url"), F.col("payload_digest"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", refers), line("WARC-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        line("WARC-Page", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
        F.lit("\r\n\r\n"),
    )


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, as the length of a record under 16 MB does; a longer one gets an empty member after it."""

    def packed(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    out = packed(record)
    return out if out.endswith(b"\0") else out + packed(b"")


def write_archives(pages: DataFrame, folder: str, *, min_payload: int = 0, date: str = "2026-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into archives of gzip members under ``folder``.

    Rows that are equal in page_id, url and payload are one record written
    repeatedly, with one id; all other records have ids of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(r.as_buffer().to_pybytes())[:-1] for r in batch.column(0)], pa.binary())], ["member"])

    resolved = resolve(pages, min_payload)
    out = resolved.select(records(resolved, date).cast("binary").alias("record")).mapInArrow(run, "member binary")
    # the writer ends each row with the zero byte that its member ends in
    out.select(F.col("member").cast("string").alias("value")).write.option("maxRecordsPerFile", records_per_file).text(folder, lineSep="\0")


def members(content: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member that holds something, one at a time."""
    at = 0
    while at < len(content):
        unzip = zlib.decompressobj(31)
        parts, begin = [], at
        while not unzip.eof:
            piece = content[at : at + (1 << 20)]
            if not len(piece):
                raise ValueError(f"the member at byte {begin} has no end")
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        if record := b"".join(parts):
            yield begin, record


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block); the block is taken by Content-Length, whatever it holds."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record: {lines[0][:40]!r}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + 4
    last = begin + int(head["Content-Length"])
    if record[last:] != b"\r\n\r\n":
        raise ValueError(f"{head['WARC-Record-ID']}: the record's end is missing")
    return head, record[begin:last]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives under ``folder``: its headers, and its payload (null for revisits).

    A response's digest is computed from what was read; another one than its
    header's is an error.  A task holds the compressed bytes of one archive, which has a bounded
    number of records, and unpacks them record by record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in HEADERS.split(", ")]
        number = lambda x: int(x) if x is not None else None
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for _, record in members(memoryview(content.as_buffer())):
                    head, block = parse_record(record)
                    kind = head["WARC-Type"]
                    whole = (len(block), block) if kind == "response" else (None, None)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload has another digest than its header says")
                    rows.append((head["WARC-Record-ID"], number(head.get("WARC-Page")), head.get("WARC-Target-URI"), kind, digest, number(head.get("WARC-Refers-To-Page")), *whole))
                    size += len(record)
                    if size > 4 << 20:
                        yield give(rows)
                        rows, size = [], 0
                if rows:
                    yield give(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, HEADERS)


def with_originals(read: DataFrame) -> DataFrame:
    """Revisit records with payload_bytes of the response that they refer to."""
    revisit = F.col("record_type") == "revisit"
    originals = read.where(~revisit & F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    found = read.where(revisit).join(originals, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("original_bytes")).select(*read.columns)
    return read.where(~revisit).unionByName(found)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
l AS (SELECT page_id, n, h, first, unnest(range(0, 8)) AS g FROM d),
v AS (SELECT page_id, n, h, first, g, CAST(concat('0x', substr(h, 5 * g + 1, 5)) AS BIGINT) AS bits FROM l),
t AS (SELECT page_id, n, first, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((bits >> 15) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((bits >> 10) & 31 AS BIGINT) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((bits >> 5) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(bits & 31 AS BIGINT) + 1, 1), '' ORDER BY g) AS payload_digest
  FROM v GROUP BY page_id, n, first)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM t
"""
