"""Listings of dataset files and their download, with an injected fetcher."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dataset string, config string, split string, url string, filename string, size long"


def listing(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A listing (as decoded from JSON) as a table."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def splits(files: DataFrame) -> DataFrame:
    """The distinct names of splits, in order; empty ones are left out."""
    return files.where("split <> ''").select("split").distinct().orderBy("split")


def of_split(files: DataFrame, split: str) -> DataFrame:
    return files.where(F.col("split") == split)


def download(rows: Iterable[dict], folder: str, fetch: Callable[[str], Iterable[bytes]]) -> list[str]:
    """Fetch files of a listing: those of the told size are skipped; others are written aside, checked
    and renamed."""
    os.makedirs(folder, exist_ok=True)
    done = []
    for r in rows:
        path, size = os.path.join(folder, os.path.basename(r["filename"])), r.get("size") or 0
        if not (os.path.exists(path) and size and os.path.getsize(path) == size):
            part, n = f"{path}.part", 0
            with open(part, "wb") as f:
                for chunk in fetch(r["url"]):
                    n += f.write(chunk)
                f.flush()
                os.fsync(f.fileno())
            if size and n != size:
                os.remove(part)
                raise OSError(f"{r['url']}: {n} bytes, not {size}")
            os.replace(part, path)
        done.append(path)
    return done
