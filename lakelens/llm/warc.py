"""Operator 3, WARC archives: records of captures are written, read back and assembled into transactions.

Writing: every page gives three records, a request, a response (or a revisit) and a metadata record, the first and last
of which name the main record in WARC-Concurrent-To. Of pages with equal payloads of at least `least_bytes` bytes the
one with the largest page_id is the response and the others revisit it, without a payload; smaller ones are all
responses. Records are put together by DataFrame expressions and Spark's own text writer stores them gzipped, CRLFs
and all, so that any file system works and a task that is run again leaves no double. Payload digests, not payloads,
decide about revisits; a payload crosses the network once.

Reading: each archive streams through a parser that goes by Content-Length. Transaction assembly joins requests and
metadata to the main records by their concurrent-to identifiers, and revisits to the responses that they refer to, and
gives one nested row per capture.

Defined results: null html is an empty payload; control characters and spaces in URLs are percent-encoded, each as its own value, and a null
URL is the empty one; rows that repeat page_id and payload are captures of their own, of which the first is the
response if it is that page's turn and the rest revisit it; null page_ids come before all others; payloads of any length
up to the two gigabytes of a value are written and read whole; an empty table gives an empty archive; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, released_shuffles, trimmed

CRLF = "\r\n"
#: Fixed values of the WARC 1.1 and base 32 standards.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of 40 hex digits: each five of them are four letters."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uuid(kind: str, *parts: Column) -> Column:
    hexed = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def encoded(url: Column) -> Column:
    """A URL whose control characters and spaces are percent-encoded, each as its own value."""
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), block)


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> str:
    """Writes the archives and returns their folder. A file holds about file_bytes of unzipped payloads: pages are dealt by
    a hash, and as many go into one file as come to that by their mean."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    clean = encoded(F.coalesce(F.col("url").cast("string"), F.lit("")))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        clean.alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    key = F.concat_ws("|", F.col("page_id").cast("string"), F.col("digest"))
    # One small row for each page: which page holds the payload. Hot digests meet pre-aggregated.
    keys = materialize(rows.groupBy("page_id", "digest").agg(F.max("bytes").alias("bytes")), "warc-keys")
    mean = keys.agg(F.avg("bytes")).first()[0] or 0.0
    rows_per_file = max(1, int(file_bytes / (mean + 1000)))
    # A written table: both sides of the join then come straight from a shuffle, and adaptive execution splits a hot digest.
    holders = materialize(keys.groupBy("digest").agg(F.max("page_id").alias("holder")).withColumnRenamed("digest", "d"), "warc-holders")
    decided = keys.join(holders, F.col("digest") == F.col("d")).where(F.col("bytes") >= least_bytes).select(key.alias("key"), F.lit(True).alias("shared"), "holder")
    # One key, also for null page_ids, serves the join and the window: payloads are dealt once.
    placed = rows.withColumn("key", key).join(decided, "key", "left")
    placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ((F.col("copy") > 1) | ~F.col("page_id").eqNullSafe(F.col("holder")))
    main = _uuid("main", F.col("page_id"), F.col("digest"), F.col("copy"))
    sha1 = F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))
    same = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", F.col("page_id"), F.col("digest"), F.col("copy"))), ("WARC-Concurrent-To", main), *same, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    answer = [("WARC-Record-ID", main), *same, ("WARC-Payload-Digest", sha1), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record([("WARC-Type", F.lit("response")), *answer], F.concat(head, F.col("html")))
    refers = _uuid("main", F.col("holder"), F.col("digest"), F.lit(1))
    again = _record([("WARC-Type", F.lit("revisit")), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), *answer], head)
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", F.col("page_id"), F.col("digest"), F.col("copy"))), ("WARC-Concurrent-To", main), *same, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    end = F.lit(CRLF + CRLF)
    value = F.concat(request, end, F.when(revisit, again).otherwise(response), end, metadata)
    with released_shuffles(spark):
        placed.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", rows_per_file).text(path)
    return path


_RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, stated_digest string, payload_digest string, payload_bytes bigint, status int, fields map<string,string>"


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an unzipped archive."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode().strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("the archive ends within a record")
        yield headers, block


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row for each record; with payload, the bytes of responses too."""
    names = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "stated_digest", "payload_digest", "payload_bytes", "status", "fields"]
    types = [pa.string()] * 8 + [pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string())]
    schema = pa.schema(list(zip(names, types, strict=True)) + [("payload", pa.binary())] * payload)

    def one(headers: dict[str, str], block: bytes) -> tuple:
        kind, digest, size, status, fields, data = headers.get("warc-type"), None, None, None, None, None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            status = int(head.split(b" ", 2)[1])
            if kind == "response":
                digest, size, data = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), body
        elif kind == "metadata":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split(CRLF) if x)]
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        row = (headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), stated, digest, size, status, fields)
        return (*row, data) if payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as zipped:
                    for headers, block in parse_warc(io.BufferedReader(zipped, 1 << 18)):
                        rows.append(one(headers, block))
                        held += len(block) if payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(trimmed(run), _RECORD + ", payload binary" * payload)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: main, request and metadata as structs, and refers_to, the main record that a revisit names."""
    request = records.where(F.col("type") == "request").select(F.col("concurrent_to").alias("request_key"), F.struct("record_id", "target_uri", "date").alias("request"))
    metadata = records.where(F.col("type") == "metadata").select(F.col("concurrent_to").alias("metadata_key"), F.struct("record_id", "fields").alias("metadata"))
    rest = [c for c in records.columns if c not in ("record_id", "concurrent_to", "refers_to", "fields")]
    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", F.col("refers_to").alias("refers_key"), F.struct(*rest).alias("main"))
    captures = main.join(request, F.col("record_id") == F.col("request_key"), "left").join(metadata, F.col("record_id") == F.col("metadata_key"), "left").drop("request_key", "metadata_key")
    # Only responses that some revisit names, each once.
    asked = main.where("refers_key is not null").select(F.col("refers_key").alias("held_key")).distinct()
    held = (
        main.select("record_id", F.col("main.payload_digest").alias("d"), F.col("main.payload_bytes").alias("b"))
        .join(asked, F.col("record_id") == F.col("held_key"), "left_semi")
        .join(metadata, F.col("record_id") == F.col("metadata_key"), "left")
        .select(F.col("record_id").alias("held_key"), F.struct("record_id", F.col("d").alias("payload_digest"), F.col("b").alias("payload_bytes"), F.col("metadata.fields").alias("fields")).alias("refers_to"))
    )
    # Many revisits may name one response: see the holders above.
    return captures.join(materialize(held, "warc-held"), F.col("refers_key") == F.col("held_key"), "left").drop("refers_key", "held_key")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    spark = pages.sparkSession
    records = materialize(read_records(spark, write_archive(pages, None, least_bytes)), "warc-records")
    page = lambda c: F.nullif(c["pageId"], F.lit("")).cast("bigint")
    digest = F.coalesce("main.payload_digest", "refers_to.payload_digest")
    return assemble(records).select(
        page(F.col("metadata.fields")).alias("page_id"),
        F.coalesce("main.payload_bytes", "refers_to.payload_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        page(F.col("refers_to.fields")).alias("refers_to"),
        F.coalesce(digest == F.col("main.stated_digest"), F.lit(False)).alias("verified"),
    )
