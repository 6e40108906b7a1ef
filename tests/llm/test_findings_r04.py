"""What the reviewer of round 4 found in the corpus operators."""

from __future__ import annotations

import io
import zlib

from lodestrata.llm import store, warc


def hiding() -> bytes:
    """A payload whose record has 2187 bytes (8b 08 00 00) after a checksum that ends with 1f: the magic, in every compression."""
    size = 2187 - len(warc.record(7, "u", b"." * 1000, None)) + 1000
    return next(p for p in (b"%06d" % i + b"." * (size - 6) for i in range(100_000)) if zlib.crc32(warc.record(7, "u", p, None)) >> 24 == 0x1F)


def test_records_whose_checksum_and_length_look_like_a_start_are_written_and_read():
    bad = hiding()
    assert len(warc.record(7, "u", bad, None)) == 2187 and warc.member(warc.record(7, "u", bad, None)) is None
    payloads = [b"before", bad, b"after"]
    raw = b"".join(warc.record_member(7, "u", p, None) for p in payloads)
    for width in (1, 100, len(raw)):
        got = [body for lo in range(0, len(raw), width) for _, body in warc.records_in(io.BytesIO(raw), lo, min(lo + width, len(raw)), len(raw))]
        assert got == payloads


def test_tables_with_such_a_record_go_through_archives(spark):
    bad = hiding().decode()
    pages = spark.createDataFrame([(7, "u", bad), (8, "u", "other")], "page_id long, url string, html string")
    archives = warc.write_warc(pages, store.new_dir(spark, "test-warc"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.all_of(warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest"), archives).collect())
    assert got == [(i, len(h), warc.payload_digest(h.encode())) for i, h in ((7, bad), (8, "other"))]
