"""Delimited files as a data source: byte ranges of files, records of any delimiter, stitched at their edges.

A record belongs to the range that it begins in; its task reads on until the record ends. Where a delimiter can overlap
itself (two line feeds in a row of three), which ones count depends on where a run begins: a task goes back
from its edge to a place that no occurrence covers, and takes occurrences from left to right from there, as a
reader of the whole file would. Files are opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system

#: Bytes of a range.
RANGE = 32 << 20
#: Bytes that are read at once, and of records that go to Spark at once.
CHUNK = 1 << 20


class Pages:
    """A file read by position through one buffer."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.begin, self.data = file, size, 0, b""

    def span(self, begin: int, end: int) -> bytes:
        begin, end = max(begin, 0), min(end, self.size)
        if begin >= end:
            return b""
        if not self.begin <= begin or end > self.begin + len(self.data):
            self.begin, self.data = begin, self.file.read_at(min(max(end - begin, CHUNK), self.size - begin), begin)
        return self.data[begin - self.begin : end - self.begin]


def free_place(pages: Pages, at: int, delimiter: bytes) -> int:
    """The last place up to ``at`` that no occurrence of the delimiter covers."""
    n = len(delimiter)
    while at > 0:
        k = pages.span(at - n + 1, at + n - 1).find(delimiter)
        if k < 0:
            return at
        at = max(at - n + 1, 0) + k  # where that occurrence begins
    return 0


def delimiter_ends(pages: Pages, begin: int, delimiter: bytes) -> Iterator[int]:
    """Ends of delimiters that do not overlap, from a free place on."""
    at, n = begin, len(delimiter)
    while at < pages.size:
        data = pages.span(at, min(at + CHUNK, pages.size))
        k, last = 0, 0
        while (k := data.find(delimiter, k)) >= 0:
            k = last = k + n
            yield at + k
        if at + len(data) >= pages.size:
            return
        at += max(last, len(data) - n + 1)


def range_records(pages: Pages, begin: int, end: int, delimiter: bytes) -> Iterator[tuple[int, int, bool]]:
    """(begin, end without delimiter, ended) of the records that begin in [begin, end)."""
    n = len(delimiter)
    start = 0 if begin == 0 else None
    for e in delimiter_ends(pages, free_place(pages, max(begin - n, 0), delimiter), delimiter):
        if start is not None:
            yield start, e - n, True
        start = e if e >= begin else None
        if start is not None and start >= end:
            return
    if start is not None and start < min(end, pages.size):
        yield start, pages.size, False


@dataclass
class Range(InputPartition):
    file: str
    size: int
    begin: int
    end: int


class DelimitedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.delimiter = json.loads(options["files"]), options["delimiter"].encode()
        self.range, self.count = int(options.get("range", RANGE)), options.get("count") == "true"
        if not self.delimiter:
            raise ValueError("an empty delimiter")

    def partitions(self):
        found = [Range(f, n, a, min(a + self.range, n)) for f, n in self.files for a in range(0, n, self.range)]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition):
        p = partition
        if p.size:
            fs, path = file_system(p.file)
            with fs.open_input_file(path) as f:
                yield from self._batches(p, Pages(f, p.size))

    def _batches(self, p: Range, pages: Pages) -> Iterator[pa.RecordBatch]:
        spans, held, line = [], 0, 0
        for a, b, ended in range_records(pages, p.begin, p.end, self.delimiter):
            text = None if self.count else pages.span(a, b)
            spans.append((text, ended))
            held += len(text or b"") + 1
            if held >= CHUNK:
                yield self._batch(p, spans, line)
                spans, held, line = [], 0, line + len(spans)
        if spans:
            yield self._batch(p, spans, line)

    def _batch(self, p: Range, spans: list, line: int) -> pa.RecordBatch:
        n = len(spans)
        columns = [
            pa.array([p.file] * n, pa.string()),
            pa.array([p.begin] * n, pa.int64()),
            pa.array(range(line, line + n), pa.int64()),
            pa.array([t for t, _ in spans], pa.binary()),
            pa.array([e for _, e in spans], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "line", "record", "ended"])


class DelimitedBytes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimitedbytes"

    def schema(self) -> str:
        return "file string, start long, line long, record binary, ended boolean"

    def reader(self, schema):
        return DelimitedReader(dict(self.options))


def read_ranges(spark: SparkSession, path: str, delimiter: str, size: int = RANGE, count: bool = False) -> DataFrame:
    """(file, start, line, record, ended) of the files that a path or glob names; with ``count`` records are null.

    Spark lists the files and their sizes, as for any source of files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    spark.dataSource.register(DelimitedBytes)
    names = json.dumps([(r.path, r.length) for r in files])
    return spark.read.format("delimitedbytes").option("files", names).option("delimiter", delimiter).option("range", str(size)).option("count", str(count).lower()).load()
