"""Binary token shards as a data source: 1024-byte header, then little-endian ids.

Writing: ``df.write.format("tokenshard").option("model", ...).option("name", ...).mode("append").save(dir)``
with columns (shard, at, tokens), all rows of a shard in one task (see ``write_shards``). Reading gives
(file, shard, tokens) with one partition per file. Files are found, opened and moved through ``pyarrow.fs`` (local, HDFS,
S3, GCS), in the planner and in tasks.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.batches import flat
from .files import file_system

# Fixed values of the public format: name -> (magic, version, numpy type)
MODELS = {"gpt-2": (20240520, 1, "<u2"), "llama-3": (20240801, 7, "<u4")}
HEADER = 1024


def serialize(tokens: np.ndarray, model: str) -> bytes:
    """Ids outside the type's range are an error."""
    magic, version, kind = MODELS[model]
    if len(tokens) and (tokens.min() < 0 or tokens.max() > np.iinfo(kind).max):
        raise ValueError(f"a token id does not fit {model}")
    return struct.pack("<3I", magic, version, len(tokens)).ljust(HEADER, b"\0") + tokens.astype(kind).tobytes()


def deserialize(raw: bytes) -> tuple[str, np.ndarray]:
    if len(raw) < HEADER:
        raise ValueError("short header")
    magic, version, n = struct.unpack_from("<3I", raw)
    for name, (m, v, kind) in MODELS.items():
        if (m, v) == (magic, version):
            if len(raw) < HEADER + n * np.dtype(kind).itemsize:
                raise ValueError("short file")
            return name, np.frombuffer(raw, kind, n, HEADER)
    raise ValueError(f"unknown model {magic}, {version}")


@dataclass
class FilePart(InputPartition):
    path: str


class ShardReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        fs, path = file_system(self.path)
        if fs.get_file_info(path).is_file:
            return [FilePart(self.path)]
        found = sorted(x.base_name for x in fs.get_file_info(FileSelector(path)) if x.is_file)
        return [FilePart(f"{self.path.rstrip('/')}/{f}") for f in found if f.endswith(".bin") and not f.startswith((".", "_"))]

    def read(self, partition):
        fs, path = file_system(partition.path)
        with fs.open_input_file(path) as f:
            model, tokens = deserialize(f.read())
        name = path.rpartition("/")[2]
        found = re.search(r"_(\d+)\.bin$", name)
        lists = pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens.astype(np.int64)))
        columns = [pa.array([name]), pa.array([int(found[1]) if found else 0], pa.int32()), pa.array([model]), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "shard", "model", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written: (file below the job's folder, name)."""

    files: list


class ShardWriter(DataSourceWriter):
    """Attempts write below a folder of the job; ``commit`` moves what the successful ones wrote to its place.

    Each attempt has a folder of its own name, so repeated, speculative and lost attempts never meet, on
    whatever hosts they run. Readers skip the job's folder; ``commit`` and ``abort`` remove it with all that is left in it.
    """

    def __init__(self, options: dict) -> None:
        self.dir, self.model, self.name = options["path"].rstrip("/"), options.get("model", "gpt-2"), options.get("name", "train")
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model}")
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows):
        """Rows arrive by shard and place, so one shard is held at a time."""
        fs, base = file_system(self.dir)
        attempt = f"{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{attempt}", recursive=True)
        files = []
        for shard, parts in itertools.groupby(rows, key=lambda r: r["shard"]):
            body = np.concatenate([np.array(r["tokens"], np.int64) for r in parts])
            name = f"{self.name}_{shard:06d}.bin"
            if any(name == n for _, n in files):
                raise ValueError("rows of a shard are apart: sort them by shard and place")
            with fs.open_output_stream(f"{base}/{attempt}/{name}") as f:
                f.write(serialize(body, self.model))
            files.append((f"{attempt}/{name}", name))
        return Written(files)

    def commit(self, messages):
        fs, base = file_system(self.dir)
        for message in messages:
            for written, name in message.files if message else []:
                fs.move(f"{base}/{written}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, base = file_system(self.dir)
        if fs.get_file_info(f"{base}/{self.job}").type != FileType.NotFound:
            fs.delete_dir(f"{base}/{self.job}")


class ArrowShardWriter(ShardWriter, DataSourceArrowWriter):
    """The writer of Arrow batches: tokens are numbers of a buffer all the way, not Python objects."""

    def write(self, batches):
        return super().write(row for batch in batches for row in batch_rows(batch))


def batch_rows(batch: pa.RecordBatch):
    """Rows (shard, tokens) with tokens as arrays."""
    tokens, offs = flat(batch.column("tokens"))
    for k, shard in enumerate(batch.column("shard").to_pylist()):
        yield {"shard": shard, "tokens": tokens[offs[k] : offs[k + 1]]}


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenshard"

    def schema(self) -> str:
        return "file string, shard int, model string, tokens array<long>"

    def reader(self, schema):
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite):
        return ArrowShardWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def write_shards(slabs: DataFrame, path: str, model: str = "gpt-2", name: str = "train") -> None:
    """Write the slabs (shard, at, tokens) of ``operators.pack.slabs``, one file a shard."""
    register(slabs.sparkSession)
    slabs.repartition("shard").sortWithinPartitions("shard", "at").write.format("tokenshard").option("model", model).option("name", name).mode("append").save(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("tokenshard").load(path)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, first): lengths of two single shards, and the first differing index, found within the two arrays."""
    both = a.select(F.col("tokens").alias("x")).crossJoin(b.select(F.col("tokens").alias("y")))
    # zip_with fills the shorter one with nulls
    at = F.array_position(F.zip_with("x", "y", lambda x, y: ~x.eqNullSafe(y)), True)
    return both.select(F.size("x").alias("n_a"), F.size("y").alias("n_b"), F.when(at > 0, (at - 1).cast("int")).alias("first"))


def peek(shards: DataFrame, n: int) -> DataFrame:
    """(file, tokens): the first n tokens of each shard; fewer are an error."""
    enough = F.when(F.size("tokens") >= n, F.slice("tokens", 1, n)).otherwise(F.raise_error(F.lit("the shard is shorter")).cast("array<bigint>"))
    return shards.select("file", enough.alias("tokens"))


def peek_text(shards: DataFrame, n: int, tokenizer) -> DataFrame:
    """(file, text): the first n tokens of each shard, decoded by an ``operators.bpe.Tokenizer``."""
    from ..operators.bpe import decode

    return decode(peek(shards, n).select(F.col("file").alias("doc"), "tokens"), tokenizer).select(F.col("doc").alias("file"), "text")
