"""What grows with the input: tasks, files and buffers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from corpusmill.operators import evaluate, pack, score
from corpusmill.operators.windows import WindowConfig
from corpusmill.plans import catalogue
from corpusmill.sources import shards


def test_delimited_files_are_as_many_as_shuffle_partitions(spark, tmp_path):
    """Not a fixed number of tasks, and their names still follow the ids."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id"), F.lit("x" * 50)).alias("text"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        path = catalogue._as_files(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    assert len(files) == 13
    first = [int(spark.read.text(f).first()[0][1:].split("x")[0]) for f in files]
    assert first == sorted(first)


def test_shards_are_written_from_arrow_batches(spark, tmp_path):
    writer = shards.TokenShards({"path": str(tmp_path / "s")}).writer(None, False)
    assert isinstance(writer, DataSourceArrowWriter)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2], pa.int32()), pa.array([0, 2, 0], pa.int32()), pa.array([[5, 6], [7], []], pa.list_(pa.int32()))], names=["shard", "at", "tokens"])
    assert [(r["shard"], r["tokens"].tolist()) for r in shards.batch_rows(batch)] == [(1, [5, 6]), (1, [7]), (2, [])]
    got = next(iter(shards.ShardReader(str(tmp_path)).read(_one(tmp_path))))
    assert isinstance(got, pa.RecordBatch) and got.to_pylist() == [{"file": "train_000003.bin", "shard": 3, "model": "gpt-2", "tokens": [1, 2, 65535]}]


def _one(path):
    (path / "train_000003.bin").write_bytes(shards.serialize(np.array([1, 2, 65535]), "gpt-2"))
    return shards.FilePart(str(path / "train_000003.bin"))


def test_slabs_of_a_stream(spark):
    rows = spark.createDataFrame([(k, bytearray(b"abcdefgh" * (k % 5))) for k in range(40)], "doc long, raw binary")
    encode = lambda t: pack.with_eot(catalogue.byte_lists(t, "raw"), 256)
    got = pack.Stream(rows, F.octet_length("raw") + 1, encode).slabs(17)
    want = pack.slabs(encode(rows), 17)
    order = lambda d: sorted(map(str, d.collect()))
    assert order(got) == order(want) and got.count() > 40


def test_a_model_that_is_known(spark):
    each = score.exploded(spark.createDataFrame([(0, [1, 2, 1, 2, 3]), (1, [2, 1])], "doc long, tokens array<int>"))
    c = WindowConfig(4, 2, True)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(evaluate.unigram_scores(each, c, score.unigram(each.select("token")))) == key(evaluate.unigram_scores(each, c))
