"""Legacy ARC archives converted to WARC.

``write_arc`` makes archives (version 1 and 2 by turns), ``convert`` turns archives into
WARC, and ``read_warc`` reads those back.  Archives are files in a store that Spark
reaches: each is one row of its text sink, of at most ``RECORDS`` records and about ``ARCHIVE_BYTES`` bytes (or one
record), so that files, rows and batches stay small whatever the pages' sizes.

An ARC file starts with a version block that names its version and fields; each record is one
header line of those fields, the last one the declared length, then that many bytes and a
line feed.  The converter reads the fields by the file's own version, takes the bytes by
their declared length, and makes of each record a WARC record with an identifier drawn
from page and digest, the ISO form of the archive date, block and payload digests, and the
type ``response``, or ``revisit`` (without payload) if the same payload of at least
``MIN_REVISIT`` bytes belongs to a record with a smaller page id.

Header lines are read as bytes and split from the right, where the number of fields is fixed, so a URL may hold blanks;
white space and bytes that are not UTF-8 are percent-encoded in it.  A broken record (too few fields, no length,
no date, cut off) does not end the job: it is left out, reading goes on at the next line that looks like a header, and
``quarantined`` lists it with its place and reason.

A null page is an empty payload; a null URL is ``about:blank``.  Records without a page id are responses.  Repeated rows
with the smallest id are all responses.  Very long pages are an archive of their own.  An empty table makes no archives and no
rows.  Columns other than page_id, url and html are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh_path, staged

RECORDS = 1000
ARCHIVE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20  # of records sent on at a time
MIN_REVISIT = 100
#: Repeated digests that are broadcast at most; beyond, the join shuffles.
BROADCAST_DIGESTS = 100_000
_SPACE = uuid.UUID("6f1c1a52-7f0e-5b7e-9c5d-1f0a6f0c2b11")
_START = datetime(2001, 1, 1)

#: The formats' own field names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 strandloom\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes, name: str) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - 0 {name}"
    return f"{url} {ip} {date} {kind}{extra} {len(body)}\n".encode() + body


class Broken(NamedTuple):
    offset: int
    reason: str
    header: bytes


_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:.* [0-9]{8,14} .* [0-9]+\r?\n")


def _uri(raw: bytes) -> str:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = "".join(chr(x) if x < 128 else f"%{x:02X}" for x in raw)
    return re.sub(r"\s", lambda m: quote(m[0]), text)


def _fields(line: bytes, names: list[str]) -> dict[str, str] | str:
    """The header line's fields, or what is wrong with it."""
    parts = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
    if len(parts) != len(names):
        return f"{len(parts)} fields where the version block names {len(names)}"
    out = {k: _uri(v) if k == "URL" else v.decode("utf-8", "replace") for k, v in zip(names, parts, strict=True)}
    if not parts[-1].isdigit():
        return "no length"
    return out if re.fullmatch(r"\d{8,14}", out.get("Archive-date", "00000000"), re.ASCII) else "no date"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord | Broken]:
    """Records of an archive by its own version's fields, and what is broken; ValueError if it is no ARC file."""
    names: list[str] | None = None
    line = stream.readline()
    while True:
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        at = stream.tell() - len(line)
        if names is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file starts with filedesc://")
            lines = _exactly(stream, int(line.split()[-1])).decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = lines[1].strip().split(" ") if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version].split(" ")
            line = stream.readline()
            continue
        fields = _fields(line, names)
        if isinstance(fields, str):
            yield Broken(at, fields, line[:1000])
            last = line.split()[-1:]
            if fields != "no length" and last and last[0].isdigit():  # the body's length is known all the same
                stream.read(int(last[0]))
            line = stream.readline()
            while line and not _HEADER.fullmatch(line):
                line = stream.readline()
            continue
        n = int(fields[names[-1]])
        body = stream.read(n)
        if len(body) != n:
            yield Broken(at, f"{n} bytes declared, {len(body)} there", line[:1000])
            return
        yield ArcRecord(fields, body)
        line = stream.readline()


def _exactly(stream: BinaryIO, n: int) -> bytes:
    out = stream.read(n)
    if len(out) != n:
        raise ValueError(f"{n} bytes declared, {len(out)} there")
    return out


def split_http(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its blank line, payload, header fields in lower case) of an HTTP response; no head if there is none."""
    if not body.startswith(b"HTTP/"):
        return b"", body, {}
    end = body.find(b"\r\n\r\n")
    if end < 0:
        return b"", body, {}
    head = body[: end + 4]
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head, body[end + 4 :], {k.lower(): v for k, v in fields.items()}


def page_of(http: dict[str, str]) -> int | None:
    mark = http.get("x-page-id", "")
    return int(mark) if re.fullmatch(r"-?\d{1,18}", mark, re.ASCII) else None


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}:{digest}')}>"


def iso(date: str) -> str:
    """ARC's 14 digits (or the first 8, 10 or 12) as a WARC date."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def warc_record(arc: ArcRecord, refers_to: int | None) -> bytes:
    head, payload, http = split_http(arc.body)
    digest = hashlib.sha256(payload).hexdigest()
    page = page_of(http)
    source = f"{arc.fields['URL']} {arc.fields['Archive-date']}" if page is None else str(page)
    revisit = refers_to is not None
    block = head if revisit else arc.body
    kind = arc.fields.get("Content-type", "application/octet-stream")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(source, digest)}",
        f"WARC-Date: {iso(arc.fields['Archive-date'])}",
        f"WARC-Target-URI: {arc.fields['URL']}",
        f"WARC-IP-Address: {arc.fields['IP-address']}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: {'application/http; msgtype=response' if head else kind}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[8:8] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(str(refers_to), digest)}",
            f"X-Refers-To-Page: {refers_to}",
            f"X-Payload-Bytes: {len(payload)}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def warcinfo(name: str) -> bytes:
    block = b"software: strandloom\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, 'warcinfo')}\r\nWARC-Date: {iso('20010101')}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each WARC record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[k.lower()] = v
        yield fields, _exactly(stream, int(fields["content-length"]))


def _archives(items: Iterator[tuple], make: Callable[[tuple, int], bytes], head: Callable[[int], bytes], separator: bytes, limits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Archives as batches of one row: ``head`` gives what the n-th archive of a task starts with, ``make`` an item's record in it."""
    held: list[bytes] = []
    size = number = 0
    for item in items:
        record = make(item, number)
        if held and (len(held) > limits[0] or size + len(record) > limits[1]):
            yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], names=["value"])
            held, size, number = [], 0, number + 1
            record = make(item, number)
        if not held:
            held.append(head(number))
        held.append(record)
        size += len(record) + len(separator)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], names=["value"])


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """Rows of one binary column ``value``, each an archive, as files."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[BinaryIO]:
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_buffer().to_pybytes()
            yield gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages as ARC archives, the record's content an HTTP response that carries the page id."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                date = (_START + timedelta(seconds=(page or 0) % 500_000_000)).strftime("%Y%m%d%H%M%S")
                yield re.sub(r"\s", lambda m: quote(m[0]), url or "about:blank"), date, body

    limits = RECORDS, ARCHIVE_BYTES

    def version(number: int) -> int:
        return 1 + number % 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _archives(
            bodies(batches),
            lambda x, n: arc_record(version(n), x[0], "192.0.2.1", x[1], "text/html", x[2], f"part-{n}.arc"),
            lambda n: arc_version_block(f"part-{n}.arc", version(n), "20010101000000"),
            b"\n",
            limits,
        )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    _write(rows.mapInArrow(run, "value binary"), path, "\n")


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[ArcRecord]:
    for stream in _streams(batches):
        yield from (x for x in read_arc(stream) if isinstance(x, ArcRecord))


def _arc_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["page_id", "digest"])

    for record in _arc_records(batches):
        _, payload, http = split_http(record.body)
        if len(payload) >= MIN_REVISIT and page_of(http) is not None:
            rows.append((page_of(http), hashlib.sha256(payload).digest()))
        if len(rows) >= 10_000:
            yield batch()
            rows.clear()
    yield batch()


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string(), pa.binary()), strict=True)], names=["page_id", "digest", "fields", "body"])

    for record in _arc_records(batches):
        if rows and size + len(record.body) > BATCH_BYTES:
            yield batch()
            rows.clear()
            size = 0
        _, payload, http = split_http(record.body)
        rows.append((page_of(http), hashlib.sha256(payload).digest(), "\n".join(f"{k} {v}" for k, v in record.fields.items()), record.body))
        size += len(record.body)
    yield batch()


def quarantined(spark: SparkSession, arc_path: str) -> DataFrame:
    """(path, offset, reason, header) of the records that ``convert`` leaves out; offsets are in the decompressed file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(1).to_pylist()):
                found = [x for stream in _streams(iter([batch.slice(i, 1)])) for x in read_arc(stream) if isinstance(x, Broken)]
                columns = [pa.array([path] * len(found), pa.string()), pa.array([x.offset for x in found], pa.int64()), pa.array([x.reason for x in found], pa.string()), pa.array([x.header for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "offset", "reason", "header"])

    files = spark.read.format("binaryFile").load(arc_path).select("content", "path")
    return files.mapInArrow(run, "path string, offset long, reason string, header binary")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """All ARC files in a folder as WARC files in another."""
    seen = _files(spark, arc_path).mapInArrow(_arc_digests, "page_id long, digest binary")
    heads = staged(seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select(F.col("digest").alias("same"), "first"), "warc-heads")
    if len(heads.limit(BROADCAST_DIGESTS + 1).select(F.lit(1)).collect()) <= BROADCAST_DIGESTS:
        heads = F.broadcast(heads)
    rows = _files(spark, arc_path).mapInArrow(_arc_rows, "page_id long, digest binary, fields string, body binary")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    rows = rows.join(heads, F.col("digest") == F.col("same"), "left").select("fields", "body", refers.alias("refers_to"))

    limits = RECORDS, ARCHIVE_BYTES

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for fields, body, refers_to in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield ArcRecord(dict(x.split(" ", 1) for x in fields.split("\n")), body.as_buffer().to_pybytes()), refers_to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _archives(records(batches), lambda x, _: warc_record(*x), lambda n: warcinfo(f"part-{n}.warc.gz"), b"\r\n\r\n", limits)

    _write(rows.mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for stream in _streams(batches):
        rows: list[tuple] = []
        for fields, block in read_records(stream):
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            if fields["warc-block-digest"] != _sha1(block):
                raise ValueError(f"block of {fields['warc-record-id']} is damaged")
            _, payload, http = split_http(block)
            digest = fields["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and digest != hashlib.sha256(payload).hexdigest():
                raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
            size = int(fields["x-payload-bytes"]) if kind == "revisit" else len(payload)
            refers = fields.get("x-refers-to-page")
            rows.append((page_of(http), size, digest, kind, refers and int(refers), fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"]))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives in a folder (warcinfo left out); digests are checked."""
    return _files(spark, path).mapInArrow(_warc_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    arc, out = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, out)
    return read_warc(spark, out)
