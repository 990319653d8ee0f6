"""Legacy archives: ARC files are parsed and converted to WARC.

An ARC file starts with a version block whose last line names the fields of the header lines that follow; version 1
has five fields, version 2 ten.  Each record is one header line, then as many bytes as its last field declares, then a
newline.  ``parse_arc`` reads either version from the declared lengths alone, so payloads may hold anything.
``to_warc`` gives each record what ARC lacks: an identifier (a name-based UUID of URL, date and place), an ISO
timestamp, a record type and SHA-256 digests; records whose payload is elsewhere become revisits that refer to it.

WARC files are runs of gzip members, one for each record, divided by an empty member, which is what Spark's text sink
writes as its line end; any WARC reader takes them, and the sink commits each file once however often tasks rerun.

Null and empty payloads are archived as empty responses.  Null URLs are written as ``-``.  Repeated rows are repeated
records.  Among equal payloads of at least ``LEAST`` bytes every row that has the smallest page id is a response; rows
with a null id come last, and are responses where no other row has the payload.  Other columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .words import portions

LEAST = 100
#: Records of an archive file at most, as a file is read by one task.
FILE_RECORDS = 10_000
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:wireloom:arc")


class Record(NamedTuple):
    version: int
    url: str
    date: str
    mime: str
    content: bytes
    place: int


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 wireloom\n{FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, date: str, mime: str, content: bytes, place: int = 0, name: str = "-") -> bytes:
    """One record; blanks in its URL are escaped, as they divide the header's fields."""
    extra = ["200", "-", "-", str(place), name] if version == 2 else []
    line = " ".join([quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\"<>\\") if url else "-", "0.0.0.0", date, mime, *extra, str(len(content))])
    return line.encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records after the version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # some writers put more than one newline between records
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(fields[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"the record at byte {at} declares {length} bytes and has {len(content)}")
        if not version:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("the archive has no version block")
            version = int(content.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        else:
            if len(fields) != len(FIELDS[version].split()):
                raise ValueError(f"the header at byte {at} has {len(fields)} fields")
            yield Record(version, fields[0], fields[2], fields[3], content, at)
        at = end + 1 + length + 1


def _block(head: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def to_warc(record: Record, key: str, refers_to: str | None = None, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    """The WARC record of an ARC record.  key: names it; refers_to: the key of the record that has its payload."""
    split = re.search(rb"\r?\n\r?\n", record.content)
    http, payload = (record.content[: split.end()], record.content[split.end() :]) if record.content.startswith(b"HTTP/") and split else (b"", record.content)
    d = record.date.ljust(14, "0")
    head = [
        ("WARC-Type", "revisit" if refers_to else "response" if http else "resource"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", record.url),
        ("Content-Type", "application/http; msgtype=response" if http else record.mime),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        *more,
    ]
    if refers_to:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
        return _block(head, http)
    return _block([*head, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(record.content).hexdigest()}")], record.content)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty gzip member, as text in which each byte is one letter.
DIVIDER = member(b"").decode("latin-1")


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members that are not empty."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        z = zlib.decompressobj(31)
        parts = []
        while at < len(view) and not z.eof:
            piece = view[at : at + (1 << 16)]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if not z.eof:
            raise ValueError("the last gzip member is cut off")
        if out := b"".join(parts):
            yield out


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of one record."""
    split = data.index(b"\r\n\r\n")
    first, *lines = data[:split].decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("this is no WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    body = data[split + 4 : split + 4 + int(head["content-length"])]
    return head, body


def _digest() -> Column:
    return F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)


def revisits(pages: DataFrame) -> DataFrame:
    """(at, of, refers_to), which are page id, digest and the other's page id, of the rows whose payload a row with a smaller id has.

    Digests are counted before they are joined; the join's rows are narrow, so a hot digest can be split.
    """
    digests = pages.select("page_id", _digest().alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    digests = digests.filter(F.col("n") >= LEAST).drop("n")
    first = digests.groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = digests.join(first, F.col("of") == F.col("digest"))
    return found.filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to").select(F.col("page_id").alias("at"), "of", "refers_to").distinct()


def write(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Archive pages (page_id, url, html): each page goes into an ARC image, alternately of version 1 and 2, that is converted to WARC."""
    same = F.col("page_id").eqNullSafe(F.col("at")) & (_digest() == F.col("of"))
    joined = pages.select("page_id", "url", "html").join(revisits(pages), same, "left").drop("at", "of")

    def run(batches):
        for batch in portions(batches, 2, rows=256):
            rows = batch.to_pylist()
            out = []
            for version in (1, 2):
                part = rows[version - 1 :: 2]
                image = [arc_head(version, "pages.arc", date)]
                for k, row in enumerate(part):
                    body = (row["html"] or "").encode()
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    image.append(arc_record(version, row["url"], date, "text/html", http + body, k))
                for row, record in zip(part, parse_arc(b"".join(image)), strict=True):
                    more = (("X-Page-Id", "" if row["page_id"] is None else str(row["page_id"])),)
                    refers = row["refers_to"]
                    out.append(member(to_warc(record, f"page:{row['page_id']}", None if refers is None else f"page:{refers}", (*more, ("X-Refers-To-Page-Id", str(refers))) if refers is not None else more)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", DIVIDER).option("encoding", "ISO-8859-1").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri) of the records under path."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for record in members(data.as_buffer().to_pybytes()):
                    head, body = parse_warc(record)
                    http, _, payload = body.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload is not what its header says")
                    page, refers = head["x-page-id"], head.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, length, digest, kind, int(refers) if refers else None, head["warc-record-id"], head["warc-target-uri"]))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
), r AS (
  SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
