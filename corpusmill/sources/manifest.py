"""Manifests: SHA-256 of every file below a folder, gitignore-like patterns, text form."""

from __future__ import annotations

import hashlib
import re
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import entries, file_system
from .scratch import staged

#: Bytes of a file that are read at a time.
PIECE = 1 << 23
#: Bytes of files that a task reads, about, and entries of a folder that are one Arrow batch.
TASK, LISTED = 1 << 28, 1 << 14


def compiled(line: str) -> tuple[re.Pattern, bool] | None:
    """(pattern for a relative path, whether it keeps) of a line; None for blanks and comments.

    A pattern that matches a folder covers all below it.
    """
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    p = line[1:] if keeps else line
    folder, anchored = p.endswith("/"), "/" in p.rstrip("/")
    p = p.strip("/")
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        elif p[k] == "[" and "]" in p[k + 1 :]:
            end = p.index("]", k + 1)
            body = p[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + re.escape(p[k]), k + 1
    head = "^" if anchored else "^(?:.*/)?"
    return re.compile(head + out + ("/.*$" if folder else "(?:/.*)?$")), keeps


def ignored(path: Column, rules: list[tuple[re.Pattern, bool]]) -> Column:
    """The last rule that matches decides; below an ignored folder nothing comes back. JVM expressions only: a
    path is out if one of its folders or the path itself is."""
    parts = F.split(path, "/")

    def out(k: Column) -> Column:
        bare = F.array_join(F.slice(parts, 1, k), "/")
        folder = k < F.size(parts)
        state = F.lit(False)
        for rule, keeps in rules:
            hit = bare.rlike(rule.pattern) | (folder & F.concat(bare, F.lit("/")).rlike(rule.pattern))
            state = F.when(hit, F.lit(not keeps)).otherwise(state)
        return state

    return F.exists(F.sequence(F.lit(1), F.size(parts)), out)


def _listed(it):
    """(item, path, length, folder) of all that is in folders (item, path)."""
    names = ["item", "path", "length", "folder"]
    for batch in it:
        for above, path in zip(batch.column("item").to_pylist(), batch.column("path").to_pylist(), strict=True):
            for some in batched(entries(path), LISTED):
                rows = [(above + name, f"{path.rstrip('/')}/{name}", length, folder) for name, length, folder in some]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(item, path, length) of the regular files below ``root``, hidden and empty ones too, which Spark's own listing leaves
    out. Tasks list the folders, a level of the tree in each round."""
    level, files = spark.createDataFrame([("", root)], "item string, path string"), None
    while True:
        found = staged(level.mapInArrow(_listed, "item string, path string, length long, folder boolean"), "walk")
        here = found.where("not folder").drop("folder")
        files = here if files is None else files.union(here)
        level = found.where("folder").select(F.concat("item", F.lit("/")).alias("item"), "path")
        if level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism)


def _hashed(it):
    """(item, sha256) of (item, path): each file is read from front to back in pieces."""
    for batch in it:
        found = []
        for path in batch.column("path").to_pylist():
            fs, at = file_system(path)
            h = hashlib.sha256()
            with fs.open_input_stream(at, compression=None) as f:
                while piece := f.read(PIECE):
                    h.update(piece)
            found.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.string())], names=["item", "sha256"])


def manifest(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """(item, sha256) of the files below ``root``; unreadable files fail the job.

    Only names and sizes are rows: a file's bytes stream through the hash in the task that reads it, so it may exceed memory
    and the 2 GB of a binary value.
    """
    rules = [r for r in map(compiled, ignore) if r]
    files = walk(spark, root)
    if rules:
        files = files.where(~ignored(F.col("item"), rules))
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = min(max(spark.sparkContext.defaultParallelism, total // TASK), max(n, 1))
    return files.select("item", "path").repartition(tasks).mapInArrow(_hashed, "item string, sha256 string")


def to_lines(m: DataFrame) -> DataFrame:
    """(value): ``hash  path`` by path."""
    return m.orderBy("item").select(F.concat_ws("  ", "sha256", "item").alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """(item, sha256) of such lines; a line without the two spaces is an error."""
    p = F.split("value", "  ", 2)
    good = F.when(F.size(p) == 2, p[1]).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))))
    return lines.where("value <> ''").select(good.alias("item"), p[0].alias("sha256"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items that were added, removed or changed."""
    j = old.withColumnRenamed("sha256", "before").join(new.withColumnRenamed("sha256", "after"), "item", "full")
    return j.where(~F.col("before").eqNullSafe(F.col("after")))
