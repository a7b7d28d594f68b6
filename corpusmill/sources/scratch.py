"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: The folder of this driver's tables, and where it was made.
_RUN = f"run-{uuid.uuid4().hex}"
_runs: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, label: str = "scratch") -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where it is unset, below a temporary folder for a
    session in one process (``local[...]``, as in tests) and an error for a cluster."""
    global _own
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own is None:
            _own = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        where = _own
    _runs.setdefault(f"{where.rstrip('/')}/corpusmill/{_RUN}", spark)
    return f"{where.rstrip('/')}/corpusmill/{_RUN}/{label}-{uuid.uuid4().hex}"


def sweep() -> None:
    """Delete all that this driver has written with ``scratch``, and has not dropped: also done when Python ends.

    Nothing that reads such a table may run any more.
    """
    for path, spark in list(_runs.items()):
        remove(spark, path)
        del _runs[path]


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        sweep()


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, whoever reads it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dropped(spent: DataFrame, then: DataFrame | None = None) -> DataFrame | None:
    """Delete what ``staged`` has written, once nothing reads it any more; gives ``then``."""
    remove(spent.sparkSession, spent.staged_at)
    return then
