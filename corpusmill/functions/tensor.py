"""Tensors as rows (idx ARRAY<INT>, value): strides, views and copies as DataFrame steps.

``Layout`` holds the arithmetic of shapes, strides and offsets of a strided view; the DataFrame
functions apply views to tables of coordinates, where a view needs no copy and ``contiguous`` collects
rows in row-major order.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_major(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(prod(shape[k + 1 :]) for k in range(len(shape)))


@dataclass(frozen=True)
class Layout:
    """A strided view of a flat buffer."""

    shape: tuple[int, ...]
    strides: tuple[int, ...] | None = None
    base: int = 0

    def __post_init__(self) -> None:
        if any(n < 0 for n in self.shape):
            raise ValueError("negative dimension")
        if self.strides is None:
            object.__setattr__(self, "strides", row_major(self.shape))
        if len(self.strides) != len(self.shape):
            raise ValueError("strides and shape differ in rank")
        if not self.shape:
            object.__setattr__(self, "base", 0 if self.strides == () and self.base < 0 else self.base)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def is_empty(self) -> bool:
        return self.size == 0

    @property
    def is_scalar(self) -> bool:
        return not self.shape

    @property
    def is_contiguous(self) -> bool:
        """Strict: dimensions of size 1 need their stride too."""
        return self.strides == row_major(self.shape)

    def offset(self, index: tuple[int, ...]) -> int:
        """Where an element lies in the buffer."""
        if len(index) != self.rank or any(not 0 <= i < n for i, n in zip(index, self.shape, strict=True)):
            raise IndexError(f"{index} outside {self.shape}")
        return self.base + sum(i * s for i, s in zip(index, self.strides, strict=True))

    def permute(self, dims: tuple[int, ...]) -> Layout:
        if sorted(dims) != list(range(self.rank)):
            raise ValueError(f"{dims} is no permutation of {self.rank} dimensions")
        return Layout(tuple(self.shape[d] for d in dims), tuple(self.strides[d] for d in dims), self.base)

    def slice(self, dim: int, start: int, end: int) -> Layout:
        if not 0 <= dim < self.rank or not 0 <= start <= end <= self.shape[dim]:
            raise IndexError("slice outside the shape")
        shape = (*self.shape[:dim], end - start, *self.shape[dim + 1 :])
        return Layout(shape, self.strides, self.base + start * self.strides[dim])

    def select(self, dim: int, at: int) -> Layout:
        if not 0 <= dim < self.rank or not 0 <= at < self.shape[dim]:
            raise IndexError("select outside the shape")
        return Layout((*self.shape[:dim], *self.shape[dim + 1 :]), (*self.strides[:dim], *self.strides[dim + 1 :]), self.base + at * self.strides[dim])

    def unravel(self, flat: int) -> tuple[int, ...]:
        out = []
        for step in row_major(self.shape):
            out.append(flat // step)
            flat %= step
        return tuple(out)

    def ravel(self, index: tuple[int, ...]) -> int:
        return sum(i * s for i, s in zip(index, row_major(self.shape), strict=True))

    def walk(self):
        """Indices in row-major order."""
        for flat in range(self.size):
            yield self.unravel(flat)

    def contiguous(self, buffer: list) -> list:
        """The elements in row-major order; the buffer itself where it already is."""
        if self.is_contiguous and self.base == 0 and len(buffer) == self.size:
            return buffer
        return [buffer[self.offset(i)] for i in self.walk()]


def unravel(flat: Column, shape: tuple[int, ...]) -> Column:
    """A row-major number as an index array."""
    steps = row_major(shape)
    return F.array(*[((flat / F.lit(s)).cast("long") if s > 1 else flat).cast("long") % F.lit(n) for s, n in zip(steps, shape, strict=True)])


def ravel(idx: Column, shape: tuple[int, ...]) -> Column:
    total = F.lit(0).cast("long")
    for k, s in enumerate(row_major(shape)):
        total = total + idx[k] * F.lit(s)
    return total


def from_rows(df: DataFrame, key: str, values: str) -> DataFrame:
    """A table with one array per leading index as coordinates."""
    return df.select(F.col(key).cast("long").alias("i"), F.posexplode(values).alias("j", "value")).select(F.array("i", F.col("j").cast("long")).alias("idx"), "value")


def permute(t: DataFrame, dims: tuple[int, ...]) -> DataFrame:
    if sorted(dims) != list(range(len(dims))):
        raise ValueError("no permutation")
    return t.withColumn("idx", F.array(*[F.col("idx")[d] for d in dims]))


def slice_dim(t: DataFrame, dim: int, start: int, end: int) -> DataFrame:
    rows = t.where((F.col("idx")[dim] >= start) & (F.col("idx")[dim] < end))
    return rows.withColumn("idx", F.transform("idx", lambda v, k: F.when(k == dim, v - start).otherwise(v)))


def select_dim(t: DataFrame, dim: int, at: int) -> DataFrame:
    return t.where(F.col("idx")[dim] == at).withColumn("idx", F.concat(F.slice("idx", 1, dim) if dim else F.array().cast("array<long>"), F.slice("idx", dim + 2, 1 << 20)))


def set_value(t: DataFrame, index: tuple[int, ...], value: Column) -> DataFrame:
    here = F.lit(True)
    for k, i in enumerate(index):
        here = here & (F.col("idx")[k] == i)
    return t.withColumn("value", F.when(here, value).otherwise(F.col("value")))


def contiguous(t: DataFrame, shape: tuple[int, ...], lead: int = 1) -> DataFrame:
    """(lead, values): rows gathered in row-major order, one array for each leading index."""
    at = ravel(F.col("idx"), shape)
    per = prod(shape[lead:])
    return (
        t.select((at / F.lit(per)).cast("long").alias("lead"), (at % F.lit(per)).alias("at"), "value")
        .groupBy("lead")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
        .select("lead", F.transform("v", lambda x: x["value"]).alias("values"))
    )
