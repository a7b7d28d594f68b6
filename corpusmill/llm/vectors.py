"""Vectors as integers: what the whitening and the code compression share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(vec_id, v array<double>, ...): rows whose vector is there and has finite entries only."""
    v = F.col(vector_col).cast("array<double>")
    d = table.select(F.col(id_col).alias("vec_id"), v.alias("v"), *more)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(odd, F.lit(True)))


def dimension(vectors: DataFrame) -> int:
    """The length of the vectors, 0 of an empty table. Vectors of several lengths are an error."""
    r = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if r[0] != r[1]:
        raise ValueError(f"vectors of {r[0]} and of {r[1]} entries")
    return r[0] or 0


def matrix(column: pa.Array, d: int, kind=np.int64) -> np.ndarray:
    """A list column of an Arrow batch as rows of ``d`` numbers."""
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, d)


def floored(v: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    """floor(scale * v) + shift; what a double or a long cannot hold exactly is an error."""
    x = np.floor(v * float(scale))
    if x.size and np.abs(x).max() > 2**52:
        raise ValueError("a vector has an entry that is too large")
    return x.astype(np.int64) + shift


def integers(vectors: DataFrame, d: int, scale: int, shift: int = 0) -> DataFrame:
    """The table with ``x array<long>`` in the place of ``v``."""

    def run(it):
        for batch in it:
            at = batch.schema.get_field_index("v")
            x = floored(matrix(batch.column(at), d, np.float64), scale, shift).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, d, dtype=np.int32), pa.array(x))
            names = ["x" if n == "v" else n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(batch.columns)], names=names)

    fields = [f"`{n}` {k}" if n != "v" else "x array<bigint>" for n, k in vectors.dtypes]
    return vectors.mapInArrow(run, ", ".join(fields))


def summed(rows: DataFrame) -> dict[int, float | int]:
    """{at: sum of value} of rows (at, value): as many numbers as a model has, added up by Spark."""
    return {r["at"]: r["value"] for r in rows.groupBy("at").agg(F.sum("value").alias("value")).collect()}
