"""Texts that arrive as a stream: splitting, pre-tokenising and windows are stateless and run unchanged.

Packing needs a global order and is for batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.pretok import pretokenize
from ..operators.windows import WindowConfig, token_windows


def stream_texts(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """(file, text) of new text files of a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def stream_windows(docs: DataFrame, c: WindowConfig, doc: str = "file") -> DataFrame:
    """Windows over the hashed pieces of each document: ids by hash need no dictionary and no state."""
    ids = F.transform(pretokenize(F.col("text")), lambda p: F.xxhash64(p))
    return token_windows(docs.select(F.col(doc).alias("doc"), ids.alias("tokens")), c)


def running_dictionary(docs: DataFrame) -> DataFrame:
    """(piece, cnt) over all that has arrived."""
    return docs.select(F.explode_outer(pretokenize(F.col("text"))).alias("piece")).where("piece is not null").groupBy("piece").agg(F.count(F.lit(1)).alias("cnt"))


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()
