"""WARC archives of pages, with repeated payloads stored once and revisit records for the rest.

Headers alone are shuffled by payload digest: the smallest page_id of a digest
is the response, the others refer to it. The archives are ordinary WARC/1.1
text written by Spark's text writer, whose line separator is the blank line
pair that ends every record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import scratch, ship

END = "\r\n\r\n"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: every 5 hex digits are 4 digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload_digest, payload_bytes and refers_to (null for a response); no payloads move.

    Payloads of fewer than `least` bytes are never revisits. A null payload is
    empty. Of repeated rows of one page_id each is a response or a revisit alike.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        base32_sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("payload_digest"),
        F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long").alias("payload_bytes"),
    )
    firsts = own.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"))
    joined = own.join(firsts, ["payload_digest", "payload_bytes"])
    again = (F.col("first_id") < F.col("page_id")) & (F.col("payload_bytes") >= least)
    return joined.select("page_id", "url", "payload_digest", "payload_bytes", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z", sizes: tuple[int, int | None] = (0, None)) -> DataFrame:
    """One WARC record text for each page, without the blank lines that end it; of pages whose payload has sizes[0] bytes or more and less than sizes[1].

    A page without page_id is a response with an empty X-Page-Id that nothing refers to.
    Rows that repeat a page_id with other payloads each have the record of their own payload.
    """
    key = ["page_id", "payload_digest"]
    decided = headers(pages, least).drop("url", "payload_bytes").dropDuplicates(key).withColumnsRenamed({k: f"decided_{k}" for k in key})
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.where(F.octet_length("html") >= sizes[0]) if sizes[0] else own
    own = own if sizes[1] is None else own.where(F.octet_length("html") < sizes[1])
    own = own.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    full = own.join(decided, F.col("page_id").eqNullSafe(F.col("decided_page_id")) & (F.col("payload_digest") == F.col("decided_payload_digest")))
    length = F.octet_length("html")
    # a line break in a URL would end its header
    clean = lambda c: F.regexp_replace(c, r"[\r\n]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return full.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: "), F.coalesce(record_id(F.col("page_id")), record_id(F.concat_ws(":", "payload_digest", "url"))),
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), clean(F.col("url")),
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
            F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
            F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("refers_to")), F.lit("\r\nWARC-Refers-To-Target-URI: "), clean(F.coalesce("refers_url", F.lit(""))), F.lit(f"\r\nWARC-Refers-To-Date: {date}\r\nX-Refers-To-Page-Id: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
            F.lit(END), block,
        ).alias("value")
    )


#: Payload sizes from which on archives hold fewer records.
CLASSES = (0, 1 << 16, 1 << 20, 1 << 24)


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = 8192, file_bytes: int = 1 << 26) -> None:
    """Deduplicated .gz archives under path, each of pages of one class of payload sizes.

    An archive has at most per_file records and file_bytes of payload, or one
    larger record, so that what reads one whole needs bounded memory.
    """
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    kind = sum(((size >= c).cast("int") for c in CLASSES[1:]), F.lit(0))
    found = sorted(r[0] for r in pages.select(kind.alias("kind")).distinct().collect())
    for k in found or [0]:
        top = CLASSES[k + 1] if k + 1 < len(CLASSES) else None
        most = min(per_file, max(1, file_bytes // top)) if top else 1
        records(pages, least, sizes=(CLASSES[k], top)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).mode("append").text(path)


_HEAD = re.compile(rb"([^\r\n:]+):[ ]?([^\r\n]*)\r\n")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of an uncompressed archive, by Content-Length."""
    at, view = 0, memoryview(content)
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        head = {k.decode().lower(): v.decode() for k, v in _HEAD.findall(content, at, stop + 2)}
        n = int(head["content-length"])
        yield head, view[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives. A response's size and digest are those of the payload read back, and payload_ok tells whether its headers state the same; a revisit has its headers' ones."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                rows = []
                raw = packed.as_buffer()
                content = raw.to_pybytes()
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                for head, block in parse(content):
                    kind = head["warc-type"]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    cut = bytes(block[:4096]).index(b"\r\n\r\n") + 4
                    size = int(re.search(rb"Content-Length: ([0-9]+)", bytes(block[:cut]))[1])
                    ok = True
                    if kind == "response":  # what was read back counts, not what the header says
                        read, digest = digest, base64.b32encode(hashlib.sha1(block[cut:]).digest()).decode()
                        ok = len(block) - cut == size and read == digest
                        size = len(block) - cut
                    refers = head.get("x-refers-to-page-id")
                    rows.append((int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"], size, digest, kind, None if refers is None else int(refers), ok))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, READ)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives to the shared folder and return what they hold.

    Every row has a record: null urls and payloads are empty, a null page_id is a
    response that nothing refers to, and rows that repeat a page_id each keep
    their own payload's digest. Other columns are ignored.
    """
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
