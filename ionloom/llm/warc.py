"""Legacy ARC archives converted to WARC, and both formats read and written.

An ARC file opens with a version block that names the fields of its record lines:
five in version 1, ten in version 2. Each record is such a line, the declared number
of bytes, and a line end. The converter gives every record a WARC identifier, an ISO
time, a type, and block and payload digests. Records with equal payloads become one
response and revisits of it, decided over all archives at once.

In ``archive_round_trip`` a null page is an empty payload, a null page id is kept as
null and is never the response if another copy has an id, and of repeated rows one is
the response. Null and odd URLs are written so that a record line keeps its fields.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ionloom.llm.files import dealt, locate, new_file, shared_folder, written
from ionloom.llm.memory import bounded_batches

ARC_BYTES, ARC_RECORDS = 64 << 20, 20_000     # a task opens a new archive beyond these
REVISIT_BYTES = 100                          # shorter payloads are never revisits

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


@dataclass
class ArcRecord:
    """One record: its place in the file, the fields of its line by name, and its bytes."""

    number: int
    fields: dict[str, str]
    block: bytes


def read_lines_and_bytes(uri: str) -> io.BufferedReader:
    """The archive's content; gzip members are joined."""
    system, path = locate(uri)
    stream = io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    return stream


def _exactly(stream: io.BufferedReader, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise ValueError(f"an archive ends within a record: {len(data)} of {size} bytes")
    return data


def _record_line(line: bytes, names: list[str]) -> dict[str, str]:
    """Fields of a record line. Only the URL may hold spaces, so fields count from the right."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not a record line of {len(names)} fields: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def read_arc(stream: io.BufferedReader) -> Iterator[ArcRecord]:
    """The version block as record 0, then every record."""
    opening = stream.readline()
    if not opening:
        return
    fields = _record_line(opening, ARC_FIELDS[1] if opening.count(b" ") == 4 else ARC_FIELDS[2])
    block = _exactly(stream, int(fields["Archive-length"]))
    lines = block.decode("utf-8", "replace").splitlines()
    version = int(lines[0].split()[0]) if lines and lines[0].split() else 0
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown archive version: {lines[:1]}")
    names = lines[1].split() if len(lines) > 1 and lines[1].split() else ARC_FIELDS[version]
    yield ArcRecord(0, fields, block)
    number = 0
    while line := stream.readline():
        if not line.strip():
            continue
        number += 1
        fields = _record_line(line, names)
        yield ArcRecord(number, fields, _exactly(stream, int(fields["Archive-length"])))


def arc_bytes(version: int, fields: dict[str, str], block: bytes) -> bytes:
    values = {**dict.fromkeys(ARC_FIELDS[version], "-"), **fields, "Archive-length": str(len(block))}
    return " ".join(values[n] for n in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def arc_opening(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 ionloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_bytes(version, {**fields, "Result-code": "200"}, block)


def iso_time(date: str) -> str:
    """The 14 digits of an ARC time as a WARC time; missing or impossible parts take their least value."""
    digits = re.sub(r"\D", "", date)[:14]
    for length, form in ((14, "%Y%m%d%H%M%S"), (12, "%Y%m%d%H%M"), (10, "%Y%m%d%H"), (8, "%Y%m%d"), (6, "%Y%m"), (4, "%Y")):
        if len(digits) >= length:
            with suppress(ValueError):
                return datetime.strptime(digits[:length], form).strftime("%Y-%m-%dT%H:%M:%SZ")
    return "1970-01-01T00:00:00Z"


def record_id(archive: str, number: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{archive.rsplit('/', 1)[-1]}#{number}").urn


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Headers (with the empty line) and payload of an HTTP response, or None."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [i + n for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(mark)) >= 0]
    end = min(ends, default=len(block))
    return block[:end], block[end:]


def header_value(headers: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", headers.decode("utf-8", "replace"))
    return found[1].strip() if found else None


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def to_warc(record: ArcRecord, archive: str, target: dict | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit if ``target`` (record_id, url, date) is given."""
    url, block = record.fields["URL"], record.block
    headers = [
        ("WARC-Record-ID", f"<{record_id(archive, record.number)}>"),
        ("WARC-Date", iso_time(record.fields["Archive-date"])),
    ]
    if record.number == 0:
        info = f"software: ionloom\r\nformat: WARC File Format 1.0\r\narc-source: {url}\r\n".encode()
        return warc_bytes([("WARC-Type", "warcinfo"), *headers, ("Content-Type", "application/warc-fields")], info)
    headers += [("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["IP-address"])]
    http = split_http(block)
    digest = hashlib.sha256(block if http is None else http[1]).hexdigest()
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if target is not None:
        block = b"" if http is None else http[0]
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<{target['record_id']}>"),
            ("WARC-Refers-To-Target-URI", target["url"]),
            ("WARC-Refers-To-Date", iso_time(target["date"])),
            ("WARC-Truncated", "length"),
        ]
    headers.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    kind = "revisit" if target is not None else "resource" if http is None else "response"
    content = record.fields["Content-type"] if http is None else "application/http; msgtype=response"
    return warc_bytes([("WARC-Type", kind), *headers, ("Content-Type", content)], block)


def read_warc(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, _exactly(stream, int(headers["content-length"]))


def _rows(values: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*values, strict=True)) if values else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


FILE = pa.schema([("path", pa.string()), ("n", pa.int64())])


class ArchiveWriter:
    """Gzip members appended to one file after another, each of bounded size."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.out, self.done = folder, suffix, None, []

    def open(self) -> str:
        self.path, self.n, self.size = new_file(self.folder, self.suffix), 0, 0
        system, path = locate(self.path)
        self.out = system.open_output_stream(path, compression=None)
        return self.path

    def add(self, data: bytes, counts: bool = True) -> None:
        self.out.write(gzip.compress(data, 1, mtime=0))
        self.n, self.size = self.n + counts, self.size + len(data)

    def full(self) -> bool:
        return self.n >= ARC_RECORDS or self.size >= ARC_BYTES

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.n))
            self.out = None


def _write_arcs(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    version = 1 + TaskContext.get().partitionId() % 2
    epoch, writer = datetime(1996, 1, 1), ArchiveWriter(folder, ".arc.gz")
    for batch in batches:
        for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            date = (epoch + timedelta(seconds=(page_id or 0) % 900_000_000)).strftime("%Y%m%d%H%M%S")
            if writer.out is None:
                writer.add(arc_opening(version, writer.open().rsplit("/", 1)[-1], date), counts=False)
            payload = (html or "").encode()
            page = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n"
            fields = {
                "URL": quote(url or "urn:unknown", safe=":/?#[]@!$&'()*+,;=%~-._") or "urn:unknown",
                "IP-address": "0.0.0.0",
                "Archive-date": date,
                "Content-type": "text/html",
                "Result-code": "200",
            }
            writer.add(arc_bytes(version, fields, head.encode() + payload))
            if writer.full():
                writer.close()
    writer.close()
    yield _rows(writer.done, FILE)


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Pages (page_id, url, html) as ARC files of both versions; returns the manifest (path, n)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(partial(_write_arcs, folder=folder), "path string, n long"), "arcs")


INDEX = pa.schema(
    [("path", pa.string()), ("number", pa.int64()), ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())]
)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with read_lines_and_bytes(path) as stream:
                rows = []
                for record in read_arc(stream):
                    http = split_http(record.block)
                    if record.number == 0 or http is None:
                        continue
                    page = header_value(http[0], PAGE_HEADER)
                    rows.append(
                        (
                            path,
                            record.number,
                            int(page) if page else None,
                            record_id(path, record.number),
                            record.fields["URL"],
                            record.fields["Archive-date"],
                            hashlib.sha256(http[1]).hexdigest(),
                            len(http[1]),
                        )
                    )
            yield _rows(rows, INDEX)


def _convert(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, revisits in zip(batch.column("path").to_pylist(), batch.column("revisits").to_pylist(), strict=True):
            targets = {r["number"]: r["target"] for r in revisits or []}
            writer = ArchiveWriter(folder, ".warc.gz")
            writer.open()
            with read_lines_and_bytes(path) as stream:
                for record in read_arc(stream):
                    writer.add(to_warc(record, path, targets.get(record.number)), counts=record.number > 0)
            writer.close()
            yield _rows(writer.done, FILE)


def convert_arcs(arcs: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Convert the ARC files of a manifest (path); returns the manifest of the WARC files.

    Of equal HTTP payloads of at least ``least`` bytes, the one with the smallest page
    id (then record id) stays a response. A file's own decisions go with the file.
    """
    n = arcs.count()
    spread = dealt(arcs.select("path"), "path", n)
    index = written(spread.mapInArrow(_index, ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'string'}" for f in INDEX)), "index")
    known = index.where(F.col("bytes") >= least)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id", "url", "date")
    first = known.groupBy("digest").agg(F.min(order).alias("target"), F.count(F.lit(1)).alias("copies"))
    revisits = (
        known.select("digest", "path", "number", "record_id")
        .join(first.where("copies > 1").select("digest", "target"), "digest")
        .where(F.col("record_id") != F.col("target.record_id"))
        .select("path", F.struct("number", F.struct("target.record_id", "target.url", "target.date").alias("target")).alias("revisit"))
    )
    # one row per file, with at most as many decisions as the file has records
    per_file = revisits.groupBy("path").agg(F.collect_list("revisit").alias("revisits"))
    work = dealt(arcs.select("path").join(per_file, "path", "left"), "path", n)
    return written(work.mapInArrow(partial(_convert, folder=folder), "path string, n long"), "warcs")


READ = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("target_uri", pa.string()), ("date", pa.string())]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with read_lines_and_bytes(path) as stream:
                rows = []
                for headers, block in read_warc(stream):
                    http = split_http(block)
                    if headers["warc-type"] not in ("response", "revisit") or http is None:
                        continue
                    digest = headers["warc-payload-digest"].partition(":")[2]
                    size = int(header_value(http[0], "Content-Length") or 0)
                    if headers["warc-type"] == "response":
                        if hashlib.sha256(http[1]).hexdigest() != digest:
                            raise ValueError(f"a payload in {path} does not have its digest")
                        size = len(http[1])
                    page = header_value(http[0], PAGE_HEADER)
                    rows.append(
                        (
                            headers["warc-record-id"].strip("<>"),
                            int(page) if page else None,
                            size,
                            digest,
                            headers["warc-type"],
                            headers.get("warc-refers-to", "").strip("<>") or None,
                            headers["warc-target-uri"],
                            headers["warc-date"],
                        )
                    )
            yield _rows(rows, READ)


def read_warcs(warcs: DataFrame) -> DataFrame:
    """Per response or revisit in the WARC files of a manifest: what it holds and the page it refers to."""
    shape = ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'string'}" for f in READ)
    records = written(dealt(warcs.select("path"), "path", warcs.count()).mapInArrow(_read, shape), "records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    rest = ["record_id", "target_uri", "date"]
    responses = records.where("target IS NULL")
    pages = responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    revisits = records.where("target IS NOT NULL").join(pages, "target", "left")
    none = F.lit(None).cast("long").alias("refers_to")
    return responses.select(*out, none, *rest).unionByName(revisits.select(*out, "refers_to", *rest))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, converted to WARC files, read back."""
    spark = pages.sparkSession
    arcs = write_arcs(pages, shared_folder(spark, "arc"))
    return read_warcs(convert_arcs(arcs, shared_folder(spark, "warc")))
