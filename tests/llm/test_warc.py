import base64
import gzip
import hashlib

from lakelens.llm import warc
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, html string, digest string, copy int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def want(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the definition, for distinct page_ids."""
    held = {}
    for p, _, h in rows:
        b = (h or "").encode()
        held[b] = max(held.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = held[b] == p or len(b) < least
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else held[b]))
    return sorted(out)


ROWS = [
    (1, "http://a.example/x", "<p>same</p>"),
    (2, "http://a.example/y z\r\nEvil: 1", "<p>same</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "https://b.example", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "https://b.example/é", "naïve ☃   text\r\n\r\n" * 50),
    (7, "http://c", "<p>same</p>"),
    (8, "http://d", "x" * 300_000),
    (9, "http://d", "x" * 300_000),
]


def test_round_trip(spark):
    got = warc.archive_pages(frame(spark, ROWS)).collect()
    assert all(r["verified"] for r in got)
    assert sorted(tuple(r)[:5] for r in got) == want(ROWS)


def test_small_payloads_are_no_revisits(spark):
    got = warc.archive_pages(frame(spark, ROWS), least_bytes=12).collect()
    assert sorted(tuple(r)[:5] for r in got) == want(ROWS, 12)


def test_archives_are_plain_warc_files(spark):
    path = warc.write_archive(frame(spark, ROWS))
    names = [r["path"].removeprefix("file:") for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    records = []
    for n in names:
        with gzip.open(n) as f:
            records += list(warc.parse_warc(f))
    assert len(records) == 3 * len(ROWS)
    assert len({h["warc-record-id"] for h, _ in records}) == len(records)
    main = {h["warc-record-id"] for h, _ in records if h["warc-type"] in ("response", "revisit")}
    assert all(h["warc-concurrent-to"] in main for h, _ in records if h["warc-type"] in ("request", "metadata"))


def test_transactions_are_nested(spark):
    records = warc.read_records(spark, warc.write_archive(frame(spark, ROWS)), payload=True)
    assert {bytes(r["payload"]).decode() for r in records.where("type = 'response'").collect()} == {h or "" for _, _, h in ROWS}
    row = warc.assemble(records.drop("payload")).where(F.col("metadata.fields")["pageId"] == "2").first()
    assert row["main"]["type"] == "revisit" and row["request"]["target_uri"] == row["main"]["target_uri"]
    assert row["refers_to"]["fields"] == {"pageId": "7"}


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (None, "u", "a"), (None, "v", "c")]
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.archive_pages(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "response", None), (1, "revisit", 1)], key=str)
    assert warc.archive_pages(frame(spark, [])).collect() == []


def test_urls_keep_their_characters(spark):
    urls = ["http://a/\tb", "http://a/ b", "http://a/\nb", "http://a/%20b", "http://a/\x7f\x00"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.encoded(F.col("url")).alias("e")).collect()
    assert [r["e"] for r in rows] == ["http://a/%09b", "http://a/%20b", "http://a/%0Ab", "http://a/%20b", "http://a/%7F%00"]
