"""The byte-level alphabet: 256 printable characters for the 256 bytes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import flat, slices


@cache
def alphabet() -> tuple[str, ...]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in printable else chr(extra))
        extra += b not in printable
    return tuple(out)


def to_symbols(raw: bytes) -> str:
    table = alphabet()
    return "".join(table[b] for b in raw)


@cache
def _bytes_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(alphabet())}


def from_symbols(symbols: str) -> bytes:
    back = _bytes_of()
    return bytes(back[c] for c in symbols)


def initial_alphabet() -> list[str]:
    """The characters by code point."""
    return sorted(alphabet())


def alphabet_table(spark: SparkSession) -> DataFrame:
    """(idx, symbol, byte) by code point of the symbol."""
    rows = sorted((c, b) for b, c in enumerate(alphabet()))
    return spark.createDataFrame([(k, c, b) for k, (c, b) in enumerate(rows)], "idx int, symbol string, byte int")


def mapped(raw: Column) -> Column:
    """The symbols of a binary value, as an Arrow function: symbols are one or two bytes of UTF-8, put in their places by
    slices, and no text is a Python object."""

    @F.arrow_udf("string")
    def f(column: pa.Array) -> pa.Array:
        values, offs = flat(column)
        first, second, size = _utf8()
        out, lens = [], []
        for i, j in slices(offs):
            b = values[offs[i] : offs[j]]
            at = np.concatenate([[0], np.cumsum(size[b])])
            data = np.empty(at[-1], np.uint8)
            data[at[:-1]] = first[b]
            two = size[b] == 2
            data[at[:-1][two] + 1] = second[b[two]]
            out.append(data)
            lens.append(np.diff(at[offs[i : j + 1] - offs[i]]))
        ends = np.concatenate([[0], *map(np.cumsum, [np.concatenate(lens)] if lens else [])]).astype(np.int64)
        data = pa.py_buffer(np.concatenate(out) if out else b"")
        told = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(ends), data])
        return pc.if_else(column.is_valid(), told, None).cast(pa.string())

    return f(raw)


@cache
def _utf8() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second byte of each byte's symbol (the second 0 where there is one), and their number."""
    coded = [c.encode() for c in alphabet()]
    return np.array([c[0] for c in coded], np.uint8), np.array([c[1] if len(c) > 1 else 0 for c in coded], np.uint8), np.array([len(c) for c in coded], np.int64)
