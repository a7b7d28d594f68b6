"""Pre-tokenisation as a JVM regular expression, and repair of invalid UTF-8."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import flat, slices

# Fixed value: the public byte-level pattern; (?U) makes the classes Unicode ones.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretokenize(text: Column) -> Column:
    """The pieces of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def with_prefix_space(text: Column) -> Column:
    """A space before a text that has none; an empty text stays empty."""
    return F.when((text == "") | text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text))


def rune_class(ch: Column) -> Column:
    """space, whitespace, letter, number or other, of a one-character string."""
    return (
        F.when(ch == " ", "space")
        .when(ch.rlike(r"(?U)^\s$"), "whitespace")
        .when(ch.rlike(r"^\p{L}$"), "letter")
        .when(ch.rlike(r"^\p{N}$"), "number")
        .otherwise("other")
    )


codecs.register_error("corpusmill-repair", lambda e: ("\ufffd", e.start + 1))


def repair_bytes(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each invalid byte (not one for each broken sequence)."""
    return raw.decode("utf-8", "corpusmill-repair")


def repaired(df: DataFrame, column: str) -> DataFrame:
    """A binary column as repaired text. Valid rows are cast in the JVM; only the rest goes to Python."""

    @F.pandas_udf("string")
    def fix(s):
        return s.map(lambda b: None if b is None else repair_bytes(bytes(b)))

    raw = F.col(column)
    return df.withColumn(column, F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(fix(raw)))


def listed(batch: pa.RecordBatch, column: str, out: str) -> Iterator[pa.RecordBatch]:
    """A batch with its binary column as lists of numbers, in batches of at most ``SLICE`` numbers or one row."""
    at = batch.schema.get_field_index(column)
    raw, parts = batch.column(at), None
    if pa.types.is_list(raw.type):
        parts = np.asarray(raw.offsets, np.int64)
        raw, parts = raw.values.slice(parts[0], parts[-1] - parts[0]), parts - parts[0]
    vals, offs = flat(raw)
    offs = offs if parts is None else offs[parts]
    names = [out if n == column else n for n in batch.schema.names]
    for i, j in slices(offs):
        own = pa.array(vals[offs[i] : offs[j]].astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array((offs[i : j + 1] - offs[i]).astype(np.int32)), own)
        yield pa.RecordBatch.from_arrays([lists if k == at else c.slice(i, j - i) for k, c in enumerate(batch.columns)], names=names)


def byte_lists(df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    """The table with a binary column's bytes as token ids in its place, straight from the Arrow buffers; null is empty. A
    column of arrays of binaries gives the bytes of each array's parts, one after the other. Lists leave in small batches: they are
    four times their bytes."""

    def run(it):
        for batch in it:
            yield from listed(batch, column, out)

    fields = [f"`{n}` {k}" if n != column else f"`{out}` array<int>" for n, k in df.dtypes]
    return df.mapInArrow(run, ", ".join(fields))


def byte_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tokens): the bytes of each text as token ids."""
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    return byte_lists(rows, "raw")
