"""Initializers of ONNX models as a data source: (row, embedding) of a named float32 matrix.

The few protobuf fields needed are read from the wire format; inline raw data, packed float data and
external files (location, offset, length) are supported. Anything but float32 is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system

FLOAT, EXTERNAL = 1, 1
#: Field numbers of the public schema: model.graph; graph.initializer; tensor fields; string pairs.
GRAPH, INITIALIZER = 7, 5
DIMS, DATA_TYPE, FLOAT_DATA, NAME, RAW, EXTERNAL_DATA, LOCATION = 1, 2, 4, 8, 9, 13, 14


class Wire:
    """A file in the wire format, read by position. Payloads are skipped; headers are read through a small buffer."""

    BUFFER = 1 << 12

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()
        self.begin, self.buffer = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """``n`` bytes from ``offset`` on."""
        if offset + n > self.size:
            raise ValueError("the file ends within a field")
        if not self.begin <= offset or offset + n > self.begin + len(self.buffer):
            self.begin, self.buffer = offset, self.file.read_at(min(max(n, self.BUFFER), self.size - offset), offset)
        return self.buffer[offset - self.begin : offset - self.begin + n]

    def varint(self, offset: int) -> tuple[int, int]:
        """(value, the offset behind it)"""
        value = shift = 0
        while True:
            b = self.at(offset, 1)[0]
            value |= (b & 0x7F) << shift
            offset, shift = offset + 1, shift + 7
            if not b & 0x80:
                return value, offset

    def fields(self, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(number, wire type, a, b) of a message in [begin, end): for numbers a is the value, for the rest the
        payload is in [a, b)."""
        while begin < end:
            key, begin = self.varint(begin)
            number, wire = key >> 3, key & 7
            if wire == 0:
                value, begin = self.varint(begin)
                yield number, wire, value, 0
                continue
            if wire == 2:
                n, begin = self.varint(begin)
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            yield number, wire, begin, begin + n
            begin += n


@dataclass(frozen=True)
class Located:
    """Where the numbers of a tensor are: shape, file, and the byte ranges that hold them, one after the other."""

    shape: tuple[int, ...]
    path: str
    spans: tuple[tuple[int, int], ...]

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


def locate(path: str, name: str) -> Located:
    """Where the named tensor of a model file is: its headers are read, no numbers."""
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        wire = Wire(f)
        for number, _, a, b in wire.fields(0, wire.size):
            if number != GRAPH:
                continue
            for kind, _, c, d in wire.fields(a, b):
                if kind == INITIALIZER and (found := _tensor(wire, c, d, name, path)) is not None:
                    return found
    raise KeyError(f"no initializer {name!r}")


def _tensor(wire: Wire, begin: int, end: int, name: str, path: str) -> Located | None:
    dims, kind, raw, own, where, outside, floats = [], 0, None, "", 0, {}, []
    for number, w, a, b in wire.fields(begin, end):
        if number == DIMS and w == 0:
            dims.append(a)
        elif number == DIMS:
            while a < b:
                d, a = wire.varint(a)
                dims.append(d)
        elif number == DATA_TYPE:
            kind = a
        elif number == FLOAT_DATA:
            floats.append((a, b - a))
        elif number == NAME:
            own = wire.at(a, b - a).decode()
        elif number == RAW:
            raw = (a, b - a)
        elif number == LOCATION:
            where = a
        elif number == EXTERNAL_DATA:
            pair = {n: wire.at(x, y - x).decode() for n, _, x, y in wire.fields(a, b)}
            outside[pair.get(1, "")] = pair.get(2, "")
    if own != name:
        return None
    if kind != FLOAT:
        raise ValueError(f"data type {kind} is not float32")
    n = 4 * math.prod(dims)
    if where == EXTERNAL:
        path = f"{path.rpartition('/')[0]}/{outside['location']}"
        spans = [(int(outside.get("offset", 0)), int(outside.get("length", n)))]
    else:
        spans = floats if raw is None else [raw]
    if sum(x for _, x in spans) != n:
        raise ValueError(f"{name!r} has other than {n} bytes")
    return Located(tuple(dims), path, tuple(spans))


def numbers(t: Located, begin: int, end: int) -> np.ndarray:
    """Bytes [begin, end) of a tensor as float32: only these are read."""
    fs, inner = file_system(t.path)
    parts, at = [], 0
    with fs.open_input_file(inner) as f:
        for offset, n in t.spans:
            a, b = max(begin, at), min(end, at + n)
            if a < b:
                parts.append(f.read_at(b - a, offset + a - at))
            at += n
    return np.frombuffer(b"".join(parts), "<f4")


def initializer(path: str, name: str) -> np.ndarray:
    """The named tensor of a model file."""
    t = locate(path, name)
    return numbers(t, 0, sum(n for _, n in t.spans)).reshape(t.shape)


#: Numbers of one partition, about.
NUMBERS = 1 << 22


@dataclass
class Rows(InputPartition):
    tensor: Located
    begin: int
    end: int


class InitializerReader(DataSourceReader):
    """The planner reads headers and cuts rows into ranges; a task reads the bytes of its own rows."""

    def __init__(self, options: dict) -> None:
        self.path, self.tensor = options["path"], options["tensor"]

    def partitions(self):
        t = locate(self.path, self.tensor)
        step = max(1, NUMBERS // max(t.width, 1))
        return [Rows(t, a, min(a + step, t.rows)) for a in range(0, t.rows, step)] or [Rows(t, 0, 0)]

    def read(self, partition):
        t, a, b = partition.tensor, partition.begin, partition.end
        values = numbers(t, 4 * a * t.width, 4 * b * t.width)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * t.width), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int32)), lists], names=["row", "embedding"])


class OnnxInitializer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "onnxinit"

    def schema(self) -> str:
        return "row int, embedding array<float>"

    def reader(self, schema):
        return InitializerReader(dict(self.options))


def read_initializer(spark: SparkSession, path: str, tensor: str) -> DataFrame:
    spark.dataSource.register(OnnxInitializer)
    return spark.read.format("onnxinit").option("tensor", tensor).load(path)


def raw_floats(spark: SparkSession, path: str) -> DataFrame:
    """(path, values): little-endian float32 files as arrays."""

    def run(it):
        for batch in it:
            values = [np.frombuffer(b.as_buffer(), "<f4") for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float32()))], names=["path", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, values array<float>")
