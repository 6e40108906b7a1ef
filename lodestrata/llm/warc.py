"""WARC archives: a writer with revisit records and a reader whose tasks take byte ranges.

An archive is a row of gzip members, one record each.  The reader deals out byte ranges of the files.  A
task looks for the gzip magic in its range and takes a candidate only if it inflates to a WARC header that
parses; from there it follows member after member.  It owns the records that start inside its range and
reads the last one beyond the range's end.

Among the bytes of a member the writer leaves no other place that would pass as the start of a record: a
record that holds one (an archive inside an archive) is compressed again in another way until it is gone.
Checksum and length at a member's end are the same in every compression: where they look like a start, the record
gets a field more.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a reader's range, bytes a file is read by, and compressed bytes that are inflated at a time.
RANGE_BYTES, READ_BYTES, STEP_BYTES = 8 << 20, 1 << 20, 1 << 14
#: An archive is closed at the first record that ends beyond this.
ARCHIVE_BYTES = 1 << 30
#: Repeated payloads whose digests are broadcast (about 100 bytes each); beyond them, lanes of a payload's copies.
BROADCAST_ROWS, LANES = 500_000, 64
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, padding: int = 0) -> bytes:
    """A response, or a revisit if it refers to another page's record; with ``padding`` a field that says nothing."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _plain(url))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)] if refers_to is not None else []),
        *([("X-Padding", "0" * padding)] if padding else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(payload) if refers_to is None else 0)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + (payload if refers_to is None else b"") + b"\r\n\r\n"


def member(raw: bytes, level: int = 3) -> bytes | None:
    """``raw`` as a gzip member within which no other record seems to start, or None if one does in every compression."""
    for lev, strategy in ((level, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (1, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_HUFFMAN_ONLY), (9, zlib.Z_FIXED)):
        deflate = zlib.compressobj(lev, zlib.DEFLATED, 31, 9, strategy)
        out = deflate.compress(raw) + deflate.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and header_of(out[at:]) is None:
            at = out.find(MAGIC, at + 1)
        if at < 0:
            return out
    return None


def record_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 3) -> bytes:
    """:func:`record` as a :func:`member`, with the least padding that lets it be one."""
    return next(m for m in (member(record(page_id, url, payload, refers_to, k), level) for k in count()) if m is not None)


def parse_header(block: bytes) -> dict[str, str] | None:
    """The fields of a header block (names in lower case), or None if it isn't one of a WARC record."""
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return None
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        try:
            fields[name.strip().lower().decode()] = value.strip().decode()
        except UnicodeDecodeError:
            return None
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def header_of(data: bytes) -> dict[str, str] | None:
    """The header of the record that the gzip member at the start of ``data`` holds: None if it holds none, and
    no fields if ``data`` ends before that is known."""
    inflate, got = zlib.decompressobj(31), bytearray()
    rest, end = data, -1
    try:
        while end < 0:
            more = inflate.decompress(rest, STEP_BYTES if got else 64)
            rest = inflate.unconsumed_tail
            got += more
            if not b"WARC/".startswith(got[:5]):
                return None
            end = got.find(b"\r\n\r\n", max(0, len(got) - len(more) - 3))
            if end < 0 and not more and not rest:
                return None if inflate.eof else {}
    except zlib.error:
        return None
    return parse_header(bytes(got[:end]))


class _Window:
    """Bytes of an open file from ``at`` on, read as they are needed."""

    def __init__(self, stream, at: int, size: int):
        self.stream, self.at, self.size, self.held, self.gone = stream, at, size, b"", 0

    def __len__(self) -> int:
        return len(self.held) - self.gone

    def reach(self, more: int) -> bool:
        """Hold at least ``more`` bytes, or all that are left."""
        while len(self) < more and self.at + len(self) < self.size:
            self.stream.seek(self.at + len(self))
            self.held, self.gone = self.held[self.gone :] + self.stream.read(max(READ_BYTES, more - len(self))), 0
        return len(self) >= more

    def first(self, n: int) -> bytes:
        return self.held[self.gone : self.gone + n]

    def find(self, what: bytes) -> int:
        at = self.held.find(what, self.gone)
        return at if at < 0 else at - self.gone

    def skip(self, n: int) -> None:
        self.gone += n
        self.at += n


def records_in(stream, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header, content)`` of the records that start in [start, end) of a file of ``size`` bytes."""
    w = _Window(stream, start, size)
    while w.at < end:
        w.reach(len(MAGIC))
        at = w.find(MAGIC)
        if at < 0:
            keep = min(len(w), len(MAGIC) - 1)
            w.skip(len(w) - keep)
            if w.at + keep >= size:
                return
            w.reach(keep + READ_BYTES)
            continue
        w.skip(at)
        if w.at >= end:
            return
        want = STEP_BYTES
        while True:  # a header may be of any length
            more = w.reach(want)
            header = header_of(w.first(want))
            if header or header is None or not more:
                break
            want *= 2
        if not header:
            w.skip(1)
            continue
        inflate, content = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            if not w.reach(1):
                raise ValueError(f"a record at the end of the file is cut off after {len(content)} bytes")
            some = w.first(STEP_BYTES)
            content += inflate.decompress(some)
            w.skip(len(some) - len(inflate.unused_data))
        body = content.find(b"\r\n\r\n") + 4
        length = int(header["content-length"])
        if len(content) < body + length:
            raise ValueError(f"a record of {length} bytes holds {len(content) - body}")
        yield header, bytes(content[body : body + length])


def _writer(base: str, level: int, archive_bytes: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def members() -> Iterator[bytes]:
            for frame in frames:
                gone, first = frame["page_id"].isna(), frame["refers_to"].isna()
                for page, url, html, to, no_id, response in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"], gone, first, strict=True):
                    yield record_member(None if no_id else int(page), url, (html or "").encode("utf-8", "surrogatepass"), None if response else int(to), level)

        ready = members()
        held = next(ready, None)
        for k in count():  # a new archive wherever one is full
            if held is None and k:
                return
            path, n, size = f"{base}/part-{part:05d}-{k:05d}.warc.gz", 0, 0

            def fill(out) -> None:
                nonlocal held, n, size
                while held is not None and size < archive_bytes:
                    out.write(held)
                    n, size, held = n + 1, size + len(held), next(ready, None)

            store.publish(path, fill)
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    return write


def plan_revisits(pages: DataFrame, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, html, refers_to``: of records with equal payloads of at least ``least_bytes`` bytes the one with the
    largest page_id is a response, the others revisit it (rows that share that page_id are all responses).
    Rows without a page_id are responses and none revisits them.  A null html is an empty payload.

    Only digests are grouped.  Those that repeat are broadcast if they are at most ``broadcast_rows``, so that no
    page is moved; more are joined, each dealt over ``LANES`` lanes, so that no payload's copies meet in one task.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("same"), F.octet_length(html).alias("size"))
    repeated = rows.where(f"page_id is not null and size >= {int(least_bytes)}").groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("same", "last")
    repeated = store.materialize(repeated, "warc-repeats")
    if repeated.count() <= broadcast_rows:
        found = rows.join(F.broadcast(repeated), "same", "left")
    else:
        lanes = repeated.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
        found = rows.withColumn("lane", F.pmod(F.xxhash64("page_id", "url"), F.lit(LANES).cast("long"))).join(lanes, ["same", "lane"], "left")
    return found.select("page_id", "url", "html", F.when((F.col("size") >= least_bytes) & (F.col("page_id") != F.col("last")), F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, base: str, least_bytes: int = 0, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html; other columns are ignored) below ``base``, a new archive
    after every ``archive_bytes``; ``path, records, bytes`` per archive."""
    planned = plan_revisits(pages, least_bytes)
    with store.batches_of(pages.sparkSession, store.TEXT_ROWS):
        return store.materialize(store.map_frames(planned, _writer(base, level, archive_bytes), "path string, records long, bytes long"), "warc-list")


def _reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def page(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    for frame in frames:
        for r in frame.itertuples(index=False):
            fs, path = store.filesystem(r.path)
            with fs.open_input_file(path) as stream:
                rows, held = [], 0
                for head, body in records_in(stream, int(r.start), int(r.end), int(r.size)):
                    kind = head["warc-type"]
                    if kind == "revisit":
                        digest, n = head.get("warc-payload-digest", "").removeprefix("sha1:"), int(head.get("x-payload-length", head["content-length"]))
                    else:
                        digest, n = payload_digest(body), len(body)
                    rows.append((page(head.get("warc-record-id")), head.get("warc-target-uri"), kind, page(head.get("warc-refers-to")), digest, n, body))
                    held += len(body)
                    if held > READ_BYTES or len(rows) >= store.TEXT_ROWS:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"], dtype=object)


def read_warc(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of ``archives`` (path, bytes), a task per range of ``range_bytes``: page_id, url, record_type,
    refers_to, payload_digest, payload_bytes and payload (empty for a revisit).  Digest and length of a response are
    those of the bytes read, of a revisit what its header says.  An empty archive has no records; a cut one is an error."""
    size, wide = F.col("bytes"), F.lit(range_bytes).cast("long")
    n = archives.agg(F.sum(F.ceil(size / wide))).first()[0] or 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), size - 1, wide))
    ranges = archives.where("bytes > 0").select("path", size.alias("size"), starts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "size"))
    return store.map_frames(ranges.repartitionByRange(int(n), "path", "start"), _reader, RECORDS)


def all_of(records: DataFrame, archives: DataFrame) -> DataFrame:
    """``records``, what is read of ``archives``, written and counted: an error if they aren't as many as were written."""
    found = store.materialize(records, "warc-records")
    written, read = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if read != written:
        raise ValueError(f"{read} records were read of archives of {written}")
    return found


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back; an error if not every record written is read."""
    archives = write_warc(store.spark_table(spark, sf_dir, "pages"), store.new_dir(spark, "warc"))
    return all_of(read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), archives)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, h FROM p),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(d.x, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN d.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = m.last THEN NULL ELSE m.last END AS refers_to
FROM d JOIN m ON d.h = m.h
"""
