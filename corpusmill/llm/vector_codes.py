"""Product codes of vectors: each part of a vector becomes the index of its codebook's nearest entry.

The nearest entry is searched by exponion: a part starts at the entry it had before, at squared distance r. Any entry that
is as near or nearer to the part is at most 2 sqrt(r) from that entry (triangle inequality), squared 4 r. So entries are
scanned along the start entry's list of neighbours, sorted by distance, while that distance is at most 4 r: all of it in
whole numbers, so ties are seen and go to the lower index. Tasks search whole batches at once, one place of the lists
after the other, and parts leave the scan as their radius ends.

A round writes the codes beside the vectors (the next round starts from them), and sums of parts by entry are added up in
tasks and then by Spark; only codebooks (16 parts x 64 entries) come to the driver.

Defined results: rows whose vector is null, empty or has a null or non-finite entry are dropped; vectors of several
lengths, a length that is no multiple of the parts, and entries that are too large for exact distances are errors. The first
codebook takes rows by id, then vector, rows without an id last, so repeated ids are a row each; fewer rows than entries
make a smaller codebook. Null labels are one group. An empty table gives an empty table; further columns,
whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .vectors import dimension, integers, matrix, summed, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors that one numpy step works on.
ROWS = 8192
#: Groups of labels up to which their sums are broadcast.
BROADCAST_LABELS = 1_000_000


class Exponion:
    """Exact nearest entries of one part's codebook (entries x width, whole numbers)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        # the entry itself first: another one at distance 0 with a lower index is found on the way
        apart[np.arange(len(entries)), np.arange(len(entries))] = -1
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def __call__(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each part, and how many distances were computed."""
        best, least = start.astype(np.int64), ((parts - self.entries[start]) ** 2).sum(axis=1)
        reach, begin = 4 * least, best.copy()
        live, computed = np.arange(len(parts)), len(parts)
        for k in range(1, len(self.entries)):
            live = live[self.apart[begin[live], k] <= reach[live]]
            if not len(live):
                break
            other = self.order[begin[live], k]
            far = ((parts[live] - self.entries[other]) ** 2).sum(axis=1)
            computed += len(live)
            better = (far < least[live]) | ((far == least[live]) & (other < best[live]))
            at = live[better]
            best[at], least[at] = other[better], far[better]
        return best, least, computed


def search(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of vectors (rows x parts) from the codes before, and the squared distances."""
    n, parts, width = len(x), books.shape[0], books.shape[2]
    found, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
    cut = x.reshape(n, parts, width)
    for p in range(parts):
        near = Exponion(books[p])
        for i in range(0, n, ROWS):
            best, least, _ = near(cut[i : i + ROWS, p], codes[i : i + ROWS, p])
            found[i : i + ROWS, p] = best
            error[i : i + ROWS] += least
    return found, error


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8).reshape(-1, parts)


def assigned(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``table`` (x, codes, ...) with the codes of ``books`` and ``error``."""
    parts, d = books.shape[0], books.shape[0] * books.shape[2]

    def run(it):
        for batch in it:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            codes, error = search(matrix(batch.column(at["x"]), d), _codes(batch.column(at["codes"]), parts), books)
            new = {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return table.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in table.dtypes))


def moved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of its parts; entries without parts stay."""
    parts, entries, width = books.shape

    def run(it):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in it:
            x, codes = matrix(batch.column(0), parts * width).reshape(-1, parts, width), _codes(batch.column(1), parts)
            for p in range(parts):
                np.add.at(total[p, :, :width], codes[:, p], x[:, p])
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(flat[at])], names=["at", "value"])

    rows = table.select("x", "codes").mapInArrow(run, "at bigint, value bigint")
    found = summed(rows.select("at", F.col("value").cast("decimal(38,0)").alias("value")))
    out, step = books.copy(), width + 1
    for k in range(parts * entries):
        count = int(found.get(k * step + width, 0))
        if count:
            out[k // entries, k % entries] = [int(found.get(k * step + j, 0)) // count for j in range(width)]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte")
    vectors = usable(table, id_col, vector_col, F.col(label_col).alias("label"))
    d = dimension(vectors)
    if d % parts:
        raise ValueError(f"{d} entries are no {parts} equal parts")
    x = integers(vectors, d or parts, SCALE)
    zero = F.lit(bytes(parts))
    now = stored(x.select("vec_id", "label", "x", zero.alias("codes"), F.lit(0).cast("long").alias("error")), "codes-0")
    first = now.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else np.zeros((parts, 1, 1), np.int64)
    largest = now.select(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0] or 0
    if 4 * d * (2 * largest) ** 2 >= 2**63:
        raise ValueError("a vector has an entry that is too large")
    for k in range(rounds):
        after = stored(assigned(now, books), f"codes-{k + 1}")
        discard(now)
        now, books = after, moved(after, books)
    done = stored(assigned(now, books).select("vec_id", "label", "codes", "error"), "codes")
    discard(now)
    sums = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumnRenamed("label", "of")
    groups = sums.count()
    near = F.broadcast(sums) if groups <= BROADCAST_LABELS else sums
    out = done.join(near, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(id_col), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
