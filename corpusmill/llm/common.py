"""Helpers shared by the operators: Arrow text buffers, word and n-gram hashing, shared storage.

Texts are handled as flat UTF-8 byte arrays with document offsets, in slices of a bounded number of
bytes (a single longer document forms a slice of its own), so that numpy works on whole slices and
memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch

#: Bytes of text that one numpy step works on.
SLICE_BYTES = 1 << 20

U = np.uint64
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- storage


def new_path(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nothing else has, in the folder of this driver, which goes when it ends."""
    return scratch(spark, label)


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends at the files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` has written, once nothing reads it any more."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of the files below ``df`` (for every store Spark reads); where a
    leaf has none, half the bytes of the texts, which are then counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(x >= 1 << 60 for x in sizes):
        return int(df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // 2
    return sum(sizes)


def fragments(df: DataFrame, per: int = 8 << 20, most_per: int = 64 << 20, cell: int = 512, least: int = 12) -> int:
    """How many fragments to cut hashes of ``df`` into, and how many buckets to deal documents to.

    A fragment or bucket is one for each ``per`` bytes of input files, and ``most_per`` at most. Between
    these it grows with the root of the input, so that a cell (what one bucket sends to one fragment) keeps
    about ``cell`` bytes of input and rows stay packed.
    """
    size = input_bytes(df)
    return max(least, -(-size // most_per), min(-(-size // per), math.isqrt(size // cell)))


# ---------------------------------------------------------------- columns


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; null texts are empty ones."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- Arrow

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def release() -> None:
    """Give freed memory back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; offsets start at 0. Nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, o, d = arr.buffers()
    offs = np.frombuffer(o, dtype=kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None and d.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES):
    """Ranges [i, j) of documents with at most ``most`` bytes together, or one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches(it, most: int = SLICE_BYTES):
    """(doc ids as Arrow, bytes, offsets, first row, batch) for slices of record batches with doc_id and text first."""
    for batch in it:
        ids = batch.column(0)
        data, offs = text_buffers(batch.column(1))
        for i, j in slices(offs, most):
            yield ids.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, batch
        del ids, data, offs, batch
        release()


def numbers(ids: pa.Array) -> np.ndarray:
    """Ids as numpy; a null is the smallest number, so its place must be kept elsewhere."""
    return np.asarray(ids.fill_null(np.iinfo(np.int64).min) if ids.null_count else ids, dtype=np.int64)


def hexes(digests) -> pa.Array:
    return pa.array([d.hex() for d in digests], pa.string())


# ---------------------------------------------------------------- words and hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_P, _Q = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_powers: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n + n // 8, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(m - 1, b, U)])) for b in (base, inv))
        if m <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _P) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span [start, end) of ``data``."""
    p, inv = powers(base, len(data) + 1)
    c = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and where each document's words begin."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = space[:-1], space[1:]
    cut = offs[1:-1]
    before[cut[cut < n]] = True
    after[cut[cut > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of a slice, and where each document's words begin."""
    starts, ends, first = word_spans(data, offs)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words, whatever document they are of (see ``gram_starts``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 8:
        h = words[:n].copy()
        for j in range(1, k):
            h *= U(_Q)
            h += words[j : j + n]
        return mix(h + U(k))
    q, inv = powers(_Q, len(words) + 1)
    c = np.zeros(len(words) + 1, U)
    np.cumsum(words * q[: len(words)], out=c[1:])
    return mix((c[k:] - c[:-k]) * inv[:n] + U(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Which word positions start a run of ``k`` words inside one document, as a mask."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    ok[left < k] = False
    return ok


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every span, one span after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    return out + np.arange(total)
