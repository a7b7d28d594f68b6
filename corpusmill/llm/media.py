"""Media columns: ISO media containers (nested boxes) written and read without decoding payloads.

``mux`` stores a payload as one track of 8-bit samples; ``probe`` walks the boxes of any such file
and turns the sample tables into byte ranges, codec, duration and keyframe ranges. 32- and 64-bit
box sizes, boxes that run to the end, constant and per-sample sizes and 32- and 64-bit chunk offsets
are read. Equal payloads give equal files.

Defined results: a null text is an empty text, and an empty text is one block of padding; every row has its
file, also rows that repeat and rows without an id, and equal texts have equal files; an empty table gives an empty
table; further columns, whatever their names, do not matter; a long text is one file, with 64-bit forms from 4 GB on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, texts

BLOCK = 576
RATE = 8000
KEY_EVERY = 8
PER_CHUNK = 16

_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``block``."""
    return data + b"\xff" * (max(1, -(-len(data) // block)) * block - len(data))


def mux(payload: bytes, block: int = BLOCK) -> bytes:
    """A file with one track of unsigned 8-bit samples, ``block`` bytes to an access unit."""
    n = len(payload) // block
    ticks = n * block
    chunks = -(-n // PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK, 1))
    keys = np.arange(1, n + 1, KEY_EVERY)

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * block)
        wide = base + len(payload) >= 1 << 32
        offsets = full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, block)),
            full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", block, n)),
            offsets,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    base = len(ftyp) + size + head
    if base + len(payload) >= 1 << 32 > len(payload):
        base = len(ftyp) + len(moov(1 << 32)) + head
    return b"".join((ftyp, moov(base), box(b"mdat", payload)))


def walk(data: memoryview, start: int, end: int, path: tuple = ()):
    """(path, body start, body end) of every box, nested ones after their parent."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in NESTED:
            yield from walk(data, start + head, start + size, here)
        start += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def ranges(self, which: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Byte ranges of samples, neighbours joined."""
        s, z = (self.starts, self.sizes) if which is None else (self.starts[which], self.sizes[which])
        if not len(s):
            return []
        new = np.concatenate([[True], s[1:] != s[:-1] + z[:-1]])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(s) - 1]])
        return [(int(a), int(b)) for a, b in zip(s[first], s[last] + z[last], strict=True)]


def _track(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> Track:
    def u4(kind: bytes, skip: int, per: int, n: int, width: str = ">u4") -> np.ndarray:
        return np.frombuffer(data, width, n * per, tables[kind][0] + skip).astype(np.int64).reshape(n, per)

    def count(kind: bytes, at: int = 4) -> int:
        return struct.unpack_from(">I", data, tables[kind][0] + at)[0]

    at = tables[b"mdhd"][0]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    codec = bytes(data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16]).decode("latin-1")
    const, n = struct.unpack_from(">II", data, tables[b"stsz"][0] + 4)
    sizes = np.full(n, const, np.int64) if const else u4(b"stsz", 12, 1, n)[:, 0]
    wide = b"co64" in tables
    kind = b"co64" if wide else b"stco"
    chunks = u4(kind, 8, 1, count(kind), ">u8" if wide else ">u4")[:, 0]
    runs = u4(b"stsc", 8, 3, count(b"stsc"))
    per = np.zeros(len(chunks), np.int64)
    for k, (first, samples, _) in enumerate(runs):
        per[first - 1 : runs[k + 1][0] - 1 if k + 1 < len(runs) else None] = samples
    chunk = np.repeat(np.arange(len(chunks)), per)[:n]
    before = np.cumsum(sizes) - sizes
    lead = before[np.concatenate([[0], np.cumsum(per)[:-1]]).clip(0, max(n - 1, 0))] if n else before
    starts = chunks[chunk] + before - lead[chunk] if n else before
    keys = u4(b"stss", 8, 1, count(b"stss"))[:, 0] - 1 if b"stss" in tables else np.arange(n)
    return Track(codec, scale, duration, starts, sizes, keys)


def probe(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes only."""
    view, tracks = memoryview(data), []
    tables: dict[bytes, tuple[int, int]] = {}
    for path, a, b in walk(view, 0, len(view)):
        if path[-1] == b"trak":
            if tables:
                tracks.append(_track(view, tables))
            tables = {}
        elif b"trak" in path:
            tables[path[-1]] = (a, b)
    if tables:
        tracks.append(_track(view, tables))
    return tracks


def stored_bytes(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in track.ranges())


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, codec string, timescale int, duration long, keyframes array<struct<start:long,end:long>>"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document with its container and the columns read from the container's tables."""

    def run(it):
        for ids, data, offs, _, _ in batches(it):
            files = [mux(pad(data[a:b].tobytes(), block), block) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            found = [probe(f)[0] for f in files]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.diff(offs)),
                    pa.array(files, pa.binary()),
                    pa.array([t.codec for t in found], pa.string()),
                    pa.array([t.timescale for t in found], pa.int32()),
                    pa.array([t.duration for t in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in t.ranges(t.keys)] for t in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_bytes", "media", "codec", "timescale", "duration", "keyframes"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, MEDIA_SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Read the stored payloads back from the containers of ``to_media`` and digest them."""

    def run(it):
        for batch in it:
            rows = []
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                track = probe(data)[0]
                payload = stored_bytes(data, track)
                keys = track.ranges(track.keys)
                feature = f"{track.codec.strip()};{track.duration}/{track.timescale};samples={len(track.sizes)};keys={len(keys)};first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)
