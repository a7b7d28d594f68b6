"""Bounded samples of labelled rows for the classifiers, and their features' common parts."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _P, SLICE_BYTES, U, held_out, mix, powers, release, slices, text_buffers

T = TypeVar("T")

#: Rows of each class that a classifier is fitted on, at most, and bytes of their texts.
PER_CLASS = 4000
CLASS_BYTES = 32 << 20


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """__id and __label of all labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(label).cast("int").alias("__label"))


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Labelled rows of each class that are not held out."""
    return {0: 0, 1: 0} | {r[0]: r[1] for r in known_labels(labels, label).groupBy("__label").count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, extra: tuple[str, ...] = (), class_bytes: int = CLASS_BYTES) -> DataFrame:
    """At most ``per_class`` rows of each class with columns __order, __id, text, label and ``extra``; a class ends
    with the row that brings its texts to ``class_bytes``.

    Rows whose crc32(doc_id) modulo 5 is 0 are held out. The choice follows a hash of the id, so it does
    not depend on how the tables are stored. The chosen ids are at most 2 * ``per_class``: they are
    broadcast, and of the documents only theirs are shuffled.
    """
    known = known_labels(labels, label).withColumn("__order", F.xxhash64("__id"))
    chosen = known.where("__label = 0").orderBy("__order", "__id").limit(per_class).union(known.where("__label = 1").orderBy("__order", "__id").limit(per_class))
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
    rows = rows.join(F.broadcast(chosen), "__id").select("__order", "__id", "text", F.col("__label").alias("label"), *extra)
    w = Window.partitionBy("label").orderBy("__order", "__id", "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"__row": F.row_number().over(w), "__before": before}).where((F.col("__row") <= per_class) & (F.col("__before") < class_bytes)).drop("__row", "__before")


def fit_on_executor(sample: DataFrame, fit: Callable[[pa.Table], T]) -> T:
    """``fit`` of a bounded sample, in its fixed order, in one task; only the model comes to the driver."""
    names = sample.columns

    def run(it):
        found = list(it)
        if not found:
            found = [pa.RecordBatch.from_arrays([pa.array([], pa.string() if n in ("text", "lang") else pa.int64()) for n in names], names=names)]
        t = pa.Table.from_batches(found).sort_by([("__order", "ascending"), ("__id", "ascending"), ("text", "ascending")]).combine_chunks()
        model = pickle.dumps(fit(t))
        del t, found
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").collect() or [[next(run([])).column(0)[0].as_py()]]
    return pickle.loads(bytes(made[0][0]))


def table_buffers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = table.column("text")
    return text_buffers(pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string()))


def sliced(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES):
    """(bytes, offsets) of bounded slices of a sample: features of one slice are made at a time."""
    for i, j in slices(offs, most):
        yield data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


class Spans:
    """Hashes of any spans of one slice of bytes, lower-cased; the prefix sums are made once."""

    def __init__(self, data: np.ndarray) -> None:
        p, self.inv = powers(_P, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[_LOWER[data]] * p[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts] + U(salt))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_f1(score: np.ndarray, hits: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The threshold of the best F1, midway between neighbouring scores; ``hits`` of the ``rows`` of a
    score (1 each, if not given) are positive."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], hits[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / ((np.arange(1, len(y) + 1) if rows is None else np.cumsum(rows[order])) + max(1, int(y.sum())))
    last = np.append(s[1:] != s[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])
