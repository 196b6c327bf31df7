"""Archives come back as written; broken ones are refused."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from stocklens.llm import queries, warc


def archive(records, dictionary=b""):
    file = io.BytesIO()
    writer = warc.ArchiveWriter(file, dictionary)
    for raw in records:
        writer.add(raw)
    return file.getvalue()


@pytest.fixture(scope="module")
def dictionary():
    samples = [f"<html><body><p>page {i} of a site with text {i * 7}</p></body></html>".encode() * 9 for i in range(99)]
    return zstandard.train_dictionary(4_096, samples).as_bytes()


def test_query_equals_its_statement(spark, duck, data):
    got = queries.warc_archives(spark, data)
    want = duck.sql(queries.statements()["op4_warc"]).fetchall()
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(want)


@pytest.mark.parametrize("with_dictionary", [True, False])
def test_round_trip(dictionary, with_dictionary):
    payloads = [b"", b"x", "é日本".encode() * 50, b"\r\n\r\nWARC/1.1\r\n" * 3, bytes(range(256)) * 999]
    data = archive([warc.record(i, "http://a/", p) for i, p in enumerate(payloads)], dictionary if with_dictionary else b"")
    found = warc.read_bytes(data)
    assert [r["payload"] for r in found] == payloads
    assert [r["payload_digest"] for r in found] == [hashlib.sha1(p).hexdigest() for p in payloads]


def test_one_frame_per_record_and_the_dictionary_first(dictionary):
    data = archive([warc.record(i, "u", b"payload") for i in range(3)], dictionary)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    assert zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]) == dictionary
    assert len(list(warc.records(io.BytesIO(data), chunk=7))) == 3


def test_broken_archives(dictionary):
    good = warc.record(1, "u", b"payload")
    whole = archive([good], dictionary)
    for broken in (b"", whole[:6], whole[:40], whole[:-3], b"\x00" * 20, good):
        with pytest.raises((warc.BrokenRecord, zstandard.ZstdError)):
            warc.read_bytes(broken)
    for raw in (
        good[:-1],
        good.replace(b"payload", b"pay"),
        good.replace(b"payload\r\n", b"PAYLOAD\r\n"),
        good.replace(b"WARC/1.1", b"HTTP/1.1"),
        good.replace(b"WARC-Date", b"WARC-Data"),
        good.replace(b"response\r\n", b"metadata\r\n", 1),
    ):
        with pytest.raises(warc.BrokenRecord):
            warc.read_bytes(archive([raw], dictionary))


def test_pages_with_odd_values(spark):
    big = "<p>" + "same " * 400
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u\r\nx", big, 3), (4, "u", big, 4), (4, "u", big, 4),
            (5, "u", "y" * 3_000_000, 5), (6, "u", "small", 6), (7, "u", "small", 7), (None, "u", "lost", 8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload bigint")
    got = warc.archived(pages)
    found = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect()}
    assert (3, "revisit", 4, len(big)) in found and (4, "response", None, len(big)) in found
    assert {(6, "response", None, 5), (7, "response", None, 5), (1, "response", None, 0)} <= found
    assert (5, "response", None, 3_000_000) in found and (None, "response", None, 4) in found
    assert got.count() == len(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_a_large_group_of_equal_pages(spark):
    pages = spark.range(3_000).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("equal "), F.lit(300)).alias("html")
    )
    rows = warc.archived(pages).groupBy("record_type", "refers_to").count().collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {("response", None, 1), ("revisit", 2_999, 2_999)}


def test_small_and_copied_tables_get_a_dictionary(spark, monkeypatch):
    def page(i):
        return f"<html><head><title>page {i}</title></head><body><p>text {i * 7} of a site</p></body></html>" * 9

    rows = [(i, "http://a/", page(i)) for i in range(60)] + [(i, "http://a/", page(0)) for i in range(60, 600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    dictionary = warc.trained_dictionary(pages)
    assert dictionary.startswith(b"\x37\xa4\x30\xec")
    given = []
    write = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda r, f, d: given.append(d) or write(r, f, d))
    assert warc.archived(pages).count() == 600 and given == [dictionary]
    assert warc.trained_dictionary(pages.limit(15)) == b""


def test_one_page_with_several_payloads(spark, tmp_path):
    """Rows of one id are records of their own: each refers to the response of its own payload, if any."""
    long_a, long_b, long_c = "a" * 1_200, "b" * 1_300, "c" * 1_400
    rows = [(1, long_a), (1, long_b), (1, long_c), (2, long_a), (3, long_b)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect())
    assert got == [
        (1, 1_200, "revisit", 2),
        (1, 1_300, "revisit", 3),
        (1, 1_400, "response", None),
        (2, 1_200, "response", None),
        (3, 1_300, "response", None),
    ]
