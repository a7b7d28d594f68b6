"""Keys of many documents in few rows: what the n-gram join and the substring dedup shuffle.

Documents are dealt to buckets by id. A bucket sums up its keys before any shuffle: each distinct key
is one entry, however many of the bucket's documents have it, so a key that all documents share is
one entry for each bucket. A row (a cell) holds what one bucket sends to one fragment of the key space:
sorted keys in one binary column, and further columns of the same length. The fragment is chosen by
other bits than the key itself has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, ragged

_LOW = U(0xFFFFFFFF)


def prime(n: int) -> int:
    """The least prime from ``n`` on: ids with a common factor still spread over that many buckets."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def dealt(texts: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, bucket): equal ids together; rows without an id by their text."""
    by = F.coalesce("doc_id", F.xxhash64("text"))
    return texts.select("doc_id", "text", F.pmod(by, F.lit(buckets)).cast("int").alias("bucket"))


def parts_of(h: np.ndarray, n: int) -> np.ndarray:
    """The fragment of each hash."""
    return (mix(h ^ U(0x5851F42D4C957F2D)) >> U(20)) % U(n)


def short_keys(h: np.ndarray, n_parts: int) -> np.ndarray:
    """The fragment of each hash above 32 bits of the hash: enough to tell which keys can be shared,
    where a wrong guess costs an entry and no result."""
    return (parts_of(h, n_parts) << U(32)) | (h & _LOW)


def cells(part: np.ndarray, bucket: int, columns: dict[str, np.ndarray], names: tuple[str, str] = ("part", "bucket")) -> pa.Table:
    """Entries sorted by ``part`` as one row for each part."""
    first, n = runs(part)
    spans = list(zip(first.tolist(), (first + n).tolist(), strict=True))
    cols = [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), bucket, np.int32))]
    cols += [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in columns.values()]
    return pa.Table.from_arrays(cols, names=[*names, *columns])


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """All entries of a binary column."""
    found = [np.frombuffer(x.as_buffer(), kind) for chunk in table.column(name).chunks for x in chunk]
    return np.concatenate(found) if found else np.zeros(0, kind)


def lengths(table: pa.Table, name: str, kind) -> np.ndarray:
    """How many entries each row has."""
    return np.array([len(x.as_buffer()) for chunk in table.column(name).chunks for x in chunk], np.int64) // np.dtype(kind).itemsize


def whole_numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


CELLS = "part int, bucket int, keys binary, counts binary"
KNOWN = "bucket int, part int, keys binary, rarity binary"


def counted(bucket: int, keys: np.ndarray) -> pa.Table:
    """``CELLS`` of a bucket: its distinct short keys and in how many documents it has each, up to 255.
    ``keys`` has a key once for each document."""
    keys, n = np.unique(keys, return_counts=True)
    return cells(keys >> U(32), bucket, {"keys": (keys & _LOW).astype(np.uint32), "counts": np.minimum(n, 255).astype(np.uint8)})


def shared(table: pa.Table) -> pa.Table:
    """Of one fragment: for each bucket, its keys that two documents have, and how rare they are
    (4 times the binary logarithm of the count)."""
    keys, counts = joined(table, "keys", np.uint32), joined(table, "counts", np.uint8)
    who = np.repeat(whole_numbers(table, "bucket"), lengths(table, "keys", np.uint32))
    order = np.argsort(keys, kind="stable")
    first, n = runs(keys[order])
    total = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else first
    rarity = np.empty(len(keys), np.uint8)
    rarity[order] = np.repeat(np.minimum(255, 4 * np.log2(np.maximum(total, 1))).astype(np.uint8), n)
    at = np.flatnonzero(rarity > 0)
    at = at[np.lexsort((keys[at], who[at]))]
    part = int(table.column("part")[0].as_py()) if table.num_rows else 0
    return cells(who[at], part, {"keys": keys[at], "rarity": rarity[at]}, ("bucket", "part"))


class Known:
    """What ``shared`` has told a bucket."""

    def __init__(self, table: pa.Table) -> None:
        part = np.repeat(whole_numbers(table, "part").astype(U), lengths(table, "keys", np.uint32)) if table.num_rows else np.zeros(0, U)
        keys = (part << U(32)) | joined(table, "keys", np.uint32).astype(U)
        order = np.argsort(keys)
        self.keys, self.rarity = keys[order], joined(table, "rarity", np.uint8)[order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether two documents have the key, its rarity)"""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.rarity[at]


def take_ranges(x: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return x[ragged(starts, lens)]
