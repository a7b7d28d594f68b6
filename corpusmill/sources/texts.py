"""Ordered documents: parquet shards, delimited files, a literal; limits and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pretok import repaired
from ..operators.order import BLOCK, dense_index_of_files, prefix_sum
from .delimited import RANGE, read_ranges

#: Longest record of a delimited file, where a guard is asked for.
MAX_RECORD = 1 << 20


def parquet_texts(spark: SparkSession, path: str | list[str], column: str = "text") -> DataFrame:
    """(doc, text) of the parquet files of a folder by (file name, row); null texts take no number.

    Only the text column is read. Anything but a string column is an error; so is an empty folder.
    """
    df = spark.read.option("recursiveFileLookup", "false").option("pathGlobFilter", "*.parquet").parquet(*([path] if isinstance(path, str) else path))
    kind = dict(df.dtypes).get(column)
    if kind != "string":
        raise ValueError(f"column {column!r} is {kind or 'absent'}, not a string")
    return dense_index_of_files(df.select(F.col(column).alias("text"), "_metadata").where("text is not null")).select("doc", "text")


def parquet_count(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(n): rows by the files' footers, nulls included."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).agg(F.count(F.lit(1)).alias("n"))


def records(df: DataFrame, key: str, text: str, delimiter: str = "\n", strip: bool = False) -> DataFrame:
    """(key, pos, record): whole texts cut after each delimiter. The delimiter stays in the record
    unless ``strip``, which for line feeds takes one carriage return before it too (not from a last
    record without delimiter). What follows the last delimiter is a record if it is not empty."""
    parts = df.select(F.col(key).alias("key"), F.split(F.col(text), _quoted(delimiter), -1).alias("parts"))
    each = parts.select("key", (F.size("parts") - 1).alias("n"), F.posexplode_outer("parts").alias("pos", "piece")).where("pos is not null")
    last = F.col("pos") == F.col("n")
    each = each.where(~last | (F.col("piece") != ""))
    if strip:
        # a carriage return alone before the delimiter stays: something must precede it
        out = F.when(last, F.col("piece")).otherwise(F.regexp_replace("piece", r"(?s)^(.+)\r\z", "$1")) if delimiter == "\n" else F.col("piece")
    else:
        out = F.when(last, F.col("piece")).otherwise(F.concat("piece", F.lit(delimiter)))
    return each.select("key", "pos", out.alias("record"))


def _quoted(s: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in s)


#: File names whose sizes say nothing about their texts.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)$"


def _file_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, start, line, record, ended): records of files in parts that Spark cuts, without a delimiter of one byte.

    ``start`` is where a part begins, ``line`` rises within it. The last record of a file has ``ended`` false
    where the file does not end in the delimiter: its records and delimiters are then longer than the file.
    """
    m = F.col("_metadata")
    lines = spark.read.option("lineSep", delimiter).text(path)
    r = lines.select(m.file_path.alias("file"), m.file_block_start.alias("start"), m.file_size.alias("size"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("record"))
    last = r.groupBy("file").agg(F.sum(F.octet_length("record").cast("long") + 1).alias("bytes"), F.max("size").alias("size"), F.max(F.struct("start", "line")).alias("at"))
    last = last.where(F.col("bytes") > F.col("size")).select("file", F.col("at.start").alias("start"), F.col("at.line").alias("line"), F.lit(False).alias("ended"))
    return r.drop("size").join(last, ["file", "start", "line"], "left").withColumn("ended", F.coalesce("ended", F.lit(True)))


def delimited_texts(spark: SparkSession, path: str, delimiter: str = "\n", strip: bool = False, most: int | None = None, whole: bool = False, part: int = RANGE) -> DataFrame:
    """(doc, text) of the delimited files that a path or glob names, by file name.

    A file is read in parts, so a long file is many tasks: parts that Spark cuts for a delimiter of one byte, byte ranges
    that are stitched at their edges for longer ones (``sources/delimited.py``). With ``whole`` (for compressed files and
    files that begin with a byte order mark) each file is one row.
    Delimiters and carriage returns are as they were. With ``most``, a longer record is an error.
    """
    if whole:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
        r = records(files, "file", "value", delimiter, strip)
        r = prefix_sum(r, [F.col("key"), F.floor(F.col("pos") / F.lit(BLOCK))], [F.col("pos")], F.lit(1), "doc")
    else:
        r = _file_records(spark, path, delimiter) if len(delimiter.encode()) == 1 else repaired(read_ranges(spark, path, delimiter, part), "record")
        packed = F.col("file").rlike(PACKED)
        r = r.withColumn("ended", F.when(packed, F.raise_error(F.lit("read compressed files whole"))).otherwise(F.col("ended")))
        bare = F.regexp_replace("record", r"(?s)^(.+)\r\z", "$1") if delimiter == "\n" else F.col("record")
        r = r.withColumn("record", F.when(~F.col("ended"), F.col("record")).otherwise(bare if strip else F.concat("record", F.lit(delimiter))))
        r = prefix_sum(r, [F.col("file"), F.col("start")], [F.col("line")], F.lit(1), "doc")
    text = F.col("record")
    if most is not None:
        text = F.when(F.octet_length("record") <= most, text).otherwise(F.raise_error(F.lit("a record is too long")).cast("string"))
    return r.select("doc", text.alias("text"))


def delimiters_in_files(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """(n): delimiters in the files that a path or glob names: a record each, but for what follows the last."""
    found = _file_records(spark, path, delimiter) if len(delimiter.encode()) == 1 else read_ranges(spark, path, delimiter, count=True)
    return found.agg(F.count(F.when(F.col("ended"), 1)).alias("n"))


def delimiter_count(df: DataFrame, text: str, delimiter: str = "\n") -> DataFrame:
    """(n): delimiters that do not overlap, over all texts."""
    gone = F.length(F.replace(F.col(text), F.lit(delimiter), F.lit("")))
    return df.agg(F.coalesce(F.sum(((F.length(text) - gone) / F.lit(len(delimiter))).cast("long")), F.lit(0)).alias("n"))


def literal_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc long, text string")


def clamped(docs: DataFrame, n: int, doc: str = "doc") -> DataFrame:
    """Documents with an index below n."""
    return docs.where(F.col(doc) < n)


def clamped_count(count: int, n: int) -> int:
    return min(count, n)
