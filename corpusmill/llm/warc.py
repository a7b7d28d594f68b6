"""WARC in ZIP packages: written by Spark, read by range without extraction.

A package is a ZIP file with the stored (not deflated) members ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (one line per record: id, offset, length). The reader
finds the end record, follows ZIP64 locators and extra fields, walks the central directory, locates
members by their local headers, reads the index and then records by byte ranges only; neighbouring ranges
are read at once, up to ``SPAN_BYTES``. Nothing is extracted, and no package is held whole.

Packages are files in the folder that executors share. A task names each file anew and reports it when it
is closed; the reports are a table that Spark commits, so files of lost or repeated tasks are never
read.

Defined results: a null payload is empty; a null id or uri is written as an absent header and read back as
null; ids may repeat and every row has its record (rows that repeat the smallest id of equal payloads are all
responses); a payload longer than a package has a package of its own; an empty table gives no package and
an empty result; further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored

#: Bytes of records in one package, about.
PACKAGE_BYTES = 8 << 20
#: Bytes that are read at once, unless one record is longer.
SPAN_BYTES = 1 << 20
#: Bytes of packages that one task reads, about.
TASK_BYTES = 32 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ---------------------------------------------------------------- ZIP


def zip_write(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with ``zip64`` all its sizes and offsets are in ZIP64 fields."""
    out, central, at = [], [], 0
    for name, body in members:
        raw, crc = name.encode(), zlib.crc32(body)
        wide = zip64 or max(len(body), at) >= 0xFFFFFFFF
        small = 0xFFFFFFFF if wide else len(body)
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if wide else b""
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, small, small, len(raw), len(extra)) + raw + extra
        if wide:
            extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at)
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + extra)
        out += [local, body]
        at += len(local) + len(body)
    size = sum(map(len, central))
    end, wide = [], zip64 or at >= 0xFFFFFFFF or len(members) >= 0xFFFF
    if wide:
        end.append(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), size, at))
        end.append(struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1))
    n = 0xFFFF if wide else len(members)
    end.append(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, 0xFFFFFFFF if wide else size, 0xFFFFFFFF if wide else at, 0))
    return b"".join([*out, *central, *end])


@dataclass
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int


class ZipRanges:
    """A ZIP file behind ``fetch(offset, length)``; nothing is read but what is asked for."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int) -> None:
        self.fetch = fetch
        tail_at = max(0, size - 65_557)
        tail = fetch(tail_at, size - tail_at)
        k = tail.rfind(b"PK\5\6")
        # the signature may also be in the comment: the right one has a comment that ends the file
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\5\6", 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, k + 10)
        if k >= 20 and tail[k - 20 : k - 16] == b"PK\6\7":
            at = struct.unpack_from("<Q", tail, k - 12)[0]
            end = fetch(at, 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members = {m.name: m for m in self._directory(fetch(start, length), count)}

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            sig, _, _, flags, method, _, _, crc, packed, size, n, x, c, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
            if sig != b"PK\1\2":
                raise ValueError("damaged central directory")
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n : at + 46 + n + x], 0
            while k + 4 <= len(extra):
                tag, size_x = struct.unpack_from("<HH", extra, k)
                if tag == 1:
                    field = k + 4
                    if size == 0xFFFFFFFF:
                        size, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                    if packed == 0xFFFFFFFF:
                        packed, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", extra, field)[0]
                k += 4 + size_x
            yield Member(name, method, size, crc, header)
            at += 46 + n + x + c

    def data_start(self, m: Member) -> int:
        if m.method:
            raise ValueError(f"{m.name} is not stored")
        head = self.fetch(m.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("damaged local header")
        n, x = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + x

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        m = self.members[name]
        return self.fetch(self.data_start(m) + offset, m.size - offset if length is None else length)


# ---------------------------------------------------------------- WARC


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or, without its payload, a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=''':/?#[]@!$&'()*+,;=~-._''')}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def parse(raw: bytes) -> dict:
    """The record in ``raw``: its headers, payload, and the digest, checked where the payload is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = h["warc-payload-digest"].removeprefix("sha1:")
    kind = h["warc-type"]
    if kind == "response" and payload_digest(payload) != told:
        raise ValueError("payload digest differs")
    uri = h.get("warc-target-uri")
    return {
        "page_id": _page(h.get("warc-record-id")),
        "url": None if uri is None else unquote(uri),
        "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": told,
        "record_type": kind,
        "refers_to": _page(h.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def package(records: list[tuple[int | None, bytes]], zip64: bool = False) -> bytes:
    """A package of (id, record) pairs."""
    body, lines, at = [], [], 0
    for page, raw in records:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        part = z.compress(raw) + z.flush()
        body.append(part)
        lines.append(json.dumps({"id": page, "offset": at, "length": len(part)}))
        at += len(part)
    return zip_write([(ARCHIVE, b"".join(body)), (INDEX, "\n".join(lines).encode())], zip64)


def read_package(fetch: Callable[[int, int], bytes], size: int, span: int = SPAN_BYTES) -> Iterator[dict]:
    """Every record of a package, by the ranges of its index."""
    z = ZipRanges(fetch, size)
    base = z.data_start(z.members[ARCHIVE])
    held: list[tuple[int, int]] = []

    def read() -> Iterator[dict]:
        begin = held[0][0]
        raw = memoryview(fetch(base + begin, held[-1][0] + held[-1][1] - begin))
        for at, n in held:
            yield parse(zlib.decompress(raw[at - begin : at - begin + n], 47))

    for line in z.read(INDEX).splitlines():
        x = json.loads(line)
        at, n = x["offset"], x["length"]
        if held and (at != held[-1][0] + held[-1][1] or at + n - held[0][0] > span):
            yield from read()
            held = []
        held.append((at, n))
    if held:
        yield from read()


# ---------------------------------------------------------------- Spark

RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, package string"
PACKAGE_SCHEMA = "package string, size long, records long"


def opened(uri: str):
    """(file system, path) of a place in the shared folder, for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", uri)))


def write_packages(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of ``pages`` (page_id, url, html) as files in ``folder``: (package, size, records). Of equal
    payloads of at least ``least`` bytes, that with the smallest id is a response and the others revisit it.

    Pages are dealt by payload hash in one shuffle against the few hashes that repeat; a hot hash is
    split by AQE. Packages are built from what a task already holds and bounded in size; every second one of
    a task, and the first, has the ZIP64 form.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("h", F.sha2("payload", 256))
    again = p.where(F.length("payload") >= least).groupBy("h").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    p = p.join(again, "h", "left").select("page_id", "url", "payload", "first")

    def run(it):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        held, size, n = [], 0, 0

        def put() -> pa.RecordBatch:
            raw, name = package(held, zip64=n % 2 == 0), f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(raw)]), pa.array([len(held)])], names=["package", "size", "records"])

        for batch in it:
            for page, url, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                revisit = first is not None and first != page
                raw = record(page, url, payload, first if revisit else None, revisit)
                held.append((page, raw))
                size += len(raw)
                if size >= package_bytes:
                    yield put()
                    held, size, n = [], 0, n + 1
        if held:
            yield put()

    return p.mapInArrow(run, PACKAGE_SCHEMA)


def read_packages(packages: DataFrame, folder: str, rows: int = 4096) -> DataFrame:
    """The records of packages (package, size) in ``folder``, read by range."""
    total = packages.agg(F.sum("size")).first()[0] or 0
    spread = packages.select("package", "size").repartition(max(1, -(-total // TASK_BYTES)))

    def run(it):
        system, root = opened(folder)
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def told(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, kinds, strict=True)], names=names)

        for batch in it:
            for name, size in zip(batch.column("package").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as f:
                    found = []
                    for r in read_package(lambda at, n, f=f: f.read_at(n, at), size):
                        del r["payload"]
                        found.append({**r, "package": name})
                        if len(found) == rows:
                            yield told(found)
                            found = []
                    if found:
                        yield told(found)

    return spread.mapInArrow(run, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the packages to the shared folder and read their records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(stored(write_packages(pages, folder, least), "warc-index"), folder)
