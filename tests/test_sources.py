import gzip
import hashlib
import io
import os
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.pretok import byte_lists
from corpusmill.operators import order, pack
from corpusmill.operators.bpe import Tokenizer
from corpusmill.sources import delimited, listing, manifest, onnx_init, shards, tables, texts


def test_parquet_texts(spark, tmp_path):
    pd.DataFrame({"text": ["c", None, "d"]}).to_parquet(tmp_path / "b.parquet")
    pd.DataFrame({"text": ["a", "b", None], "n": [1, 2, 3]}).to_parquet(tmp_path / "a.parquet")
    got = texts.parquet_texts(spark, str(tmp_path))
    assert [(r.doc, r.text) for r in got.orderBy("doc").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert texts.parquet_count(spark, str(tmp_path)).first().n == 6
    assert [r.doc for r in texts.clamped(got, 2).orderBy("doc").collect()] == [0, 1] and texts.clamped_count(4, 9) == 4
    with pytest.raises(ValueError, match="not a string"):
        texts.parquet_texts(spark, str(tmp_path / "a.parquet"), "n")


def test_records(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\r"), (2, ""), (3, "x\n"), (4, "\r\n")], "k int, t string")
    keep = {}
    for r in texts.records(df, "k", "t").orderBy("key", "pos").collect():
        keep.setdefault(r.key, []).append(r.record)
    assert keep == {1: ["a\r\n", "b\n", "\n", "c\r"], 3: ["x\n"], 4: ["\r\n"]}
    strip = {}
    for r in texts.records(df, "k", "t", strip=True).orderBy("key", "pos").collect():
        strip.setdefault(r.key, []).append(r.record)
    assert strip == {1: ["a", "b", "", "c\r"], 3: ["x"], 4: ["\r"]}
    two = spark.createDataFrame([(1, "a\n\n\nb")], "k int, t string")
    assert [r.record for r in texts.records(two, "k", "t", "\n\n").orderBy("pos").collect()] == ["a\n\n", "\nb"]
    assert texts.delimiter_count(two, "t", "\n\n").first().n == 1 and texts.delimiter_count(df, "t").first().n == 5


def test_delimited_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("3\n4")
    (tmp_path / "a.txt").write_text("1\r\n2\r\n")
    (tmp_path / "c.txt").write_text("")
    got = texts.delimited_texts(spark, str(tmp_path / "*.txt"), strip=True).orderBy("doc").collect()
    assert [(r.doc, r.text) for r in got] == [(0, "1"), (1, "2"), (2, "3"), (3, "4")]
    whole = texts.delimited_texts(spark, str(tmp_path / "*.txt"), whole=True).orderBy("doc").collect()
    assert [r.text for r in whole] == ["1\r\n", "2\r\n", "3\n", "4"] == [r.text for r in texts.delimited_texts(spark, str(tmp_path / "*.txt")).orderBy("doc").collect()]
    assert texts.delimiters_in_files(spark, str(tmp_path / "*.txt")).first().n == 3 == texts.delimiter_count(spark.read.text(str(tmp_path / "*.txt"), wholetext=True), "value").first().n
    with pytest.raises(Exception, match="too long"):
        texts.delimited_texts(spark, str(tmp_path / "*.txt"), most=1).collect()
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(b"a\nb"))
    assert [r.text for r in texts.delimited_texts(spark, str(tmp_path / "z*"), whole=True).orderBy("doc").collect()] == ["a\n", "b"]
    with pytest.raises(Exception, match="whole"):
        texts.delimited_texts(spark, str(tmp_path / "z*")).collect()
    assert texts.literal_text(spark, "x").first().doc == 0


def test_long_files_are_cut_by_spark(spark, tmp_path):
    """Records of a file in many parts, with empty records, carriage returns and multi-byte letters at the cuts."""
    rng = random.Random(6)
    for name, end in (("a", "\n"), ("b", "é"), ("c", "\n\n")):
        text = "".join(rng.choice(["é", "x", "\r\n", "\n", "中文", "  "]) for _ in range(4000)) + end
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert texts._file_records(spark, str(tmp_path / "*.txt"), "\n").select("file", "start").distinct().count() > 9
        for strip in (False, True):
            got = texts.delimited_texts(spark, str(tmp_path / "*.txt"), strip=strip)
            want = texts.delimited_texts(spark, str(tmp_path / "*.txt"), strip=strip, whole=True)
            assert [tuple(r) for r in got.orderBy("doc").collect()] == [tuple(r) for r in want.orderBy("doc").collect()]
        assert texts.delimiters_in_files(spark, str(tmp_path / "*.txt")).first().n == sum((tmp_path / f"{x}.txt").read_bytes().count(b"\n") for x in "abc")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("keys", [range(-20, 200, 3), [k * 7919 * 10**14 % 2**62 - 2**61 for k in range(300)], [*range(150), 2**62, -(2**63)]])
def test_order(spark, keys, monkeypatch):
    """Dense ids, ids spread over all numbers, and dense ids with far ones."""
    df = spark.createDataFrame([(k, abs(k) * 7 % 5) for k in keys], "k long, v int")
    rows = sorted((r.k, r.v) for r in df.collect())
    got = {r.k: (r.doc, r.before) for r in order.ordered_sum(order.dense_index(df, "k"), "k", F.col("v"), "before").collect()}
    total = 0
    for i, (k, v) in enumerate(rows):
        assert got[k] == (i, total)
        total += v
    bounds = order.key_bounds(df, F.col("k"), 40)
    block = {r.k: r.b for r in df.select("k", order.block_of(F.col("k"), bounds, 8).alias("b")).collect()}
    assert all(block[k] == sum(b <= k for b in bounds) for k in block) and 20 < len(set(block.values())) <= 41
    assert order.dense_index(df.limit(0), "k").count() == 0


@pytest.mark.parametrize(("size", "model"), [(7, "gpt-2"), (64, "llama-3"), (10_000, "gpt-2")])
def test_packing_and_shards(spark, tmp_path, size, model):
    rng = np.random.default_rng(size)
    docs = [rng.integers(0, 300, rng.integers(0, 10)).tolist() for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc long, tokens array<int>")
    stream = [t for d in docs for t in [999, *d]]
    eot = pack.with_eot(df, 999)
    flat = [r.token for r in pack.positions(eot, size).orderBy("g").collect()]
    assert flat == stream
    shards.write_shards(pack.slabs(eot, size), str(tmp_path), model, "train")
    got = shards.read_shards(spark, str(tmp_path)).orderBy("shard").collect()
    assert [r.file for r in got] == [pack.shard_name("train", k) for k in range(-(-len(stream) // size))]
    assert [t for r in got for t in r.tokens] == stream and {r.model for r in got} == {model}
    stats = pack.promoted(pack.shard_stats(eot, size)).orderBy("shard").collect()
    assert [r.n_tokens for r in stats] == [len(r.tokens) for r in got] and stats[0].split == "val"
    one = shards.read_shards(spark, str(tmp_path / "train_000000.bin"))
    assert tuple(shards.diff(one, one).first()) == (len(got[0].tokens), len(got[0].tokens), None)
    assert shards.peek(one, 3).first().tokens == stream[:3]
    name = lambda k: chr(64 + k // 32) + chr(64 + k % 32)
    text = shards.peek_text(one, 3, Tokenizer({name(k): k for k in range(1000)}, ())).first().text
    assert text == "".join(map(name, stream[:3]))


def test_shard_bytes():
    raw = shards.serialize(np.array([1, 2, 65535]), "gpt-2")
    assert len(raw) == 1024 + 6 and struct.unpack_from("<3I", raw) == (20240520, 1, 3) and raw[1024:1026] == b"\1\0"
    for bad in (b"", raw[:1028], b"\1" + raw[1:]):
        with pytest.raises(ValueError):
            shards.deserialize(bad)
    with pytest.raises(ValueError):
        shards.serialize(np.array([65536]), "gpt-2")


def test_first_mismatch(spark):
    a = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "g long, token int")
    b = spark.createDataFrame([(0, 1), (1, 5)], "g long, token int")
    assert tuple(pack.first_mismatch(a, b).first()) == (3, 2, 1, 2, 5)
    assert tuple(pack.first_mismatch(a, a).first()) == (3, 3, None, None, None)


def _field(number, payload):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    return varint(number << 3) + varint(payload) if isinstance(payload, int) else varint(number << 3 | 2) + varint(len(payload)) + payload


def test_onnx_initializers(spark, tmp_path):
    rows = np.arange(12, dtype="<f4").reshape(4, 3)
    dims = _field(1, 4) + _field(1, 3) + _field(2, 1)
    inline = dims + _field(8, b"wte") + _field(9, rows.tobytes())
    (tmp_path / "w.bin").write_bytes(b"xx" + rows.tobytes())
    pair = lambda k, v: _field(13, _field(1, k) + _field(2, v))
    outside = dims + _field(8, b"far") + pair(b"location", b"w.bin") + pair(b"offset", b"2") + pair(b"length", b"48") + _field(14, 1)
    wrong = _field(1, 1) + _field(2, 7) + _field(8, b"int") + _field(9, bytes(8))
    (tmp_path / "m.onnx").write_bytes(_field(1, 8) + _field(7, b"".join(_field(5, t) for t in (inline, outside, wrong))))
    for name in ("wte", "far"):
        got = onnx_init.read_initializer(spark, str(tmp_path / "m.onnx"), name).orderBy("row").collect()
        assert [list(r.embedding) for r in got] == rows.tolist()
    with pytest.raises(ValueError):
        onnx_init.initializer(str(tmp_path / "m.onnx"), "int")
    with pytest.raises(KeyError):
        onnx_init.initializer(str(tmp_path / "m.onnx"), "none")
    rows.tofile(tmp_path / "x.f32")
    assert onnx_init.raw_floats(spark, str(tmp_path / "x.f32")).first()["values"] == rows.ravel().tolist()


def test_manifest_of_all_kinds_of_files(spark, tmp_path, monkeypatch):
    """Empty, hidden, compressed, deep and oddly named files are in it; links are not."""
    monkeypatch.setattr(manifest, "PIECE", 1 << 10)
    monkeypatch.setattr(manifest, "LISTED", 2)
    data = {"a.txt": b"", "b c/d.gz": gzip.compress(b"x" * 9), "b c/e%20f.bin": bytes(range(256)) * 40, ".hidden/_x/y": b"y" * 101, "_SUCCESS": b"z", "\u00e9": b"q"}
    root = tmp_path / "root"
    for name, raw in data.items():
        (root / name).parent.mkdir(exist_ok=True, parents=True)
        (root / name).write_bytes(raw)
    (root / "none").mkdir()
    (tmp_path / "else").write_bytes(b"1")
    (root / "link").symlink_to(tmp_path / "else")
    (root / "b c" / "up").symlink_to(root)
    got = {r.item: r.sha256 for r in manifest.manifest(spark, str(root)).collect()}
    assert got == {name: hashlib.sha256(raw).hexdigest() for name, raw in data.items()}
    assert {r.item: r.sha256 for r in manifest.manifest(spark, f"file://{root}/").collect()} == got
    assert {r.item for r in manifest.manifest(spark, str(root), ["*.gz", ".*", "!*.gz", "_*"]).collect()} == {"a.txt", "b c/d.gz", "b c/e%20f.bin", "\u00e9"}
    assert manifest.manifest(spark, str(root / "none")).count() == 0
    with pytest.raises(Exception, match="missing"):
        manifest.manifest(spark, str(root / "missing"))


def test_manifest_of_a_file_above_2_gb(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "big", "wb") as f:
        f.truncate(size)  # sparse: no disk is used
    h, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        h.update(zeros)
    h.update(zeros[: size & ((1 << 24) - 1)])
    assert [tuple(r) for r in manifest.manifest(spark, str(tmp_path)).collect()] == [("big", h.hexdigest())]


def test_manifest(spark, tmp_path):
    root = tmp_path / "r"
    for name in ("a.txt", "b.log", "sub/c.txt", "sub/deep/d.log", "out/e.txt", "keep.log"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    m = manifest.manifest(spark, str(root), ["# none", "", "*.log", "!keep.log", "out/"])
    got = {r.item: r.sha256 for r in m.collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.txt", "sub/c.txt", "keep.log")}
    lines = manifest.to_lines(m)
    assert lines.first().value == f"{got['a.txt']}  a.txt"
    assert {r.item: r.sha256 for r in manifest.from_lines(lines).collect()} == got
    assert manifest.changed(m, manifest.from_lines(lines)).count() == 0
    with pytest.raises(Exception, match="malformed"):
        manifest.from_lines(spark.createDataFrame([("x y",)], "value string")).collect()


def test_listing_and_download(spark, tmp_path):
    rows = [{"dataset": "d", "config": "c", "split": s, "url": f"u/{k}", "filename": f"{k}.parquet", "size": 3} for k, s in enumerate(["train", "", "test", "train"])]
    files = listing.listing(spark, rows)
    assert [r.split for r in listing.splits(files).collect()] == ["test", "train"] and listing.of_split(files, "train").count() == 2
    asked = []

    def fetch(url):
        asked.append(url)
        return [b"ab", b"c"]

    assert len(listing.download(rows[:2], str(tmp_path), fetch)) == 2 and len(asked) == 2
    listing.download(rows[:2], str(tmp_path), fetch)
    assert len(asked) == 2
    with pytest.raises(OSError):
        listing.download([{**rows[2], "size": 4}], str(tmp_path), fetch)


def test_tables(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for n in (1, 1):
        assert tables.memoised(spark, "memo_t", build).count() == 3 and len(calls) == n
    tables.memoised(spark, "memo_t", build, force=True)
    assert len(calls) == 2
    tables.append(spark.range(2), "memo_t")
    assert spark.table("memo_t").count() == 5
    assert tables.rebuilt(spark.range(4), "memo_t").count() == 4
    spark.sql("DROP TABLE memo_t")


# ---------------------------------------------------------------- ranges of delimited files


class Raw:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        self.read += n
        return self.data[offset : offset + n]


def whole_records(data, delimiter):
    parts = data.split(delimiter)
    return [(p, True) for p in parts[:-1]] + ([(parts[-1], False)] if parts[-1] else [])


@pytest.mark.parametrize("delimiter", [b"\n\n", b"aa", b"aba", b"aabaa", b"abc", b"\xc3\xa9\xc3", b"a"])
def test_ranges_give_the_records_of_the_whole_file(delimiter, monkeypatch):
    """Every cut of files full of runs, also where the buffer is smaller than a delimiter needs."""
    rng = random.Random(len(delimiter))
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(delimited, "CHUNK", chunk)
        for _ in range(40):
            data = b"".join(rng.choice([delimiter, delimiter[:1], delimiter[-1:], b"x", b"ab"]) for _ in range(rng.randrange(40)))
            for size in (1, 2, 3, 5, 64):
                got = []
                for a in range(0, len(data), size):
                    pages = delimited.Pages(Raw(data), len(data))
                    got += [(pages.span(x, y), e) for x, y, e in delimited.range_records(pages, a, min(a + size, len(data)), delimiter)]
                assert got == whole_records(data, delimiter)


def test_a_range_reads_little_beyond_itself():
    data = b"".join(b"record %d<|end|>" % k for k in range(400_000))
    raw = Raw(data)
    pages = delimited.Pages(raw, len(data))
    assert sum(1 for _ in delimited.range_records(pages, 3_000_000, 3_100_000, b"<|end|>")) > 4000
    assert raw.read <= 3 * delimited.CHUNK


@pytest.mark.parametrize("delimiter", ["\n\n", "<|end|>", "中文"])
def test_delimiters_of_several_bytes_in_cut_files(spark, tmp_path, delimiter):
    rng = random.Random(9)
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text("".join(rng.choice([delimiter, "\n", "é", "中", "<|", "x", "  "]) for _ in range(3000)) + "end")
    (tmp_path / "d.txt").write_text("")
    files = str(tmp_path / "*.txt")
    want = texts.delimited_texts(spark, files, delimiter, whole=True).orderBy("doc").collect()
    assert len({r.start for r in delimited.read_ranges(spark, files, delimiter, 1000).collect()}) > 5
    got = texts.delimited_texts(spark, files, delimiter, part=1000).orderBy("doc").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) > 500
    assert texts.delimiters_in_files(spark, files, delimiter).first().n == sum((tmp_path / f"{x}.txt").read_text().count(delimiter) for x in "abc")
    (tmp_path / "e.txt.gz").write_bytes(gzip.compress(b"a"))
    with pytest.raises(Exception, match="whole"):
        texts.delimited_texts(spark, str(tmp_path / "e*"), delimiter).collect()


# ---------------------------------------------------------------- commit and ranges of binary files


def test_attempts_of_tasks_meet_only_in_commit(tmp_path):
    """A repeated and a lost attempt leave nothing behind."""
    w = shards.ShardWriter({"path": f"file://{tmp_path}/out"})
    rows = [{"shard": 1, "tokens": [1, 2]}, {"shard": 1, "tokens": [3]}, {"shard": 4, "tokens": [9]}]
    first, again, other = w.write(rows), w.write(rows), w.write([{"shard": 2, "tokens": [5]}])

    def broken():
        yield rows[0]
        yield rows[2]
        raise OSError("lost")

    with pytest.raises(OSError):
        w.write(broken())
    assert shards.ShardReader(f"{tmp_path}/out").partitions() == []
    assert len({f for m in (first, again, other) for f, _ in m.files}) == 5
    w.commit([again, other, None])
    assert sorted(os.listdir(tmp_path / "out")) == ["train_000001.bin", "train_000002.bin", "train_000004.bin"]
    assert shards.deserialize((tmp_path / "out/train_000001.bin").read_bytes())[1].tolist() == [1, 2, 3]
    gone = shards.ShardWriter({"path": str(tmp_path / "out")})
    gone.write([{"shard": 7, "tokens": [5]}])
    gone.abort([])
    assert len(os.listdir(tmp_path / "out")) == 3
    with pytest.raises(ValueError, match="apart"):
        w.write([rows[0], rows[2], rows[1]])


def test_a_failed_job_leaves_no_shard(spark, tmp_path):
    slabs = spark.range(40).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("at"), F.array(F.when(F.col("id") == 37, 70_000).otherwise(5)).alias("tokens"))
    with pytest.raises(Exception, match="does not fit"):
        shards.write_shards(slabs, str(tmp_path / "s"), "gpt-2")
    assert not (tmp_path / "s").exists() or os.listdir(tmp_path / "s") == []
    shards.write_shards(slabs.where("shard <> 37"), str(tmp_path / "s"), "gpt-2")
    assert shards.read_shards(spark, str(tmp_path / "s")).count() == 39 == len(os.listdir(tmp_path / "s"))


def test_first_mismatch_joins_one_block(spark):
    a = spark.range(50_000).select(F.col("id").alias("g"), (F.col("id") % 7).cast("int").alias("token"))
    b = a.withColumn("token", F.when(F.col("g") == 31_000, 99).otherwise(F.col("token"))).where("g < 49000")
    got = pack.first_mismatch(a, b, block=512)
    assert tuple(got.first()) == (50_000, 49_000, 31_000, 31_000 % 7, 99)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{31_000 // 512 * 512}") >= 2  # both sides are filtered to the block before they meet
    assert tuple(pack.first_mismatch(a, a.where("g < 1000"), block=512).first()) == (50_000, 1000, 1000, 1000 % 7, None)
    empty = a.limit(0)
    assert tuple(pack.first_mismatch(empty, empty).first()) == (0, 0, None, None, None)
    twice = a.union(a.where("g = 5"))
    assert pack.first_mismatch(a, twice).first().n_b == 50_001


def _stream_of(spark, docs, doc="doc"):
    rows = spark.createDataFrame([(k, t) for k, t in docs], f"{doc} long, raw binary")
    return pack.Stream(rows, F.coalesce(F.octet_length("raw"), F.lit(0)), lambda t: byte_lists(t, "raw"), doc)


def test_streams_give_any_range(spark):
    rng = random.Random(5)
    docs = [(k * 7 % 90, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 200])))) for k in range(90)] + [(1000, None)]
    want = b"".join(t for _, t in sorted(docs) if t)
    stream = _stream_of(spark, docs)
    assert [(r.g, r.token) for r in stream().orderBy("g").collect()] == list(enumerate(want))
    for low, high in ((0, 1), (5, 5), (17, 900), (len(want) - 3, len(want) + 10), (len(want), len(want) + 1)):
        assert [(r.g, r.token) for r in stream(low, high).orderBy("g").collect()] == list(enumerate(want))[low:high]
    assert "Exchange hashpartitioning" not in stream(17, 900)._jdf.queryExecution().executedPlan().toString()
    assert stream(17, 17 + (pack.NARROW << 1)).count() == len(want) - 17  # too many documents to be broadcast
    assert _stream_of(spark, [])().count() == 0


def test_first_mismatch_of_streams_with_other_documents(spark):
    """Streams are told apart by position and token, wherever their documents begin."""
    text = bytes(k * k % 251 for k in range(5000))
    a = _stream_of(spark, [(k, text[k * 100 : k * 100 + 100]) for k in range(50)])
    b = _stream_of(spark, [(k, text[k * 125 : k * 125 + 125]) for k in range(40)])
    other = bytearray(text)
    other[4321] ^= 1
    other[4999] ^= 1
    c = _stream_of(spark, [(9, bytes(other[:4000])), (10, b""), (12, bytes(other[4000:]))])
    assert tuple(pack.first_mismatch(a, b, block=64).first()) == (5000, 5000, None, None, None)
    assert tuple(pack.first_mismatch(a, c, block=64).first()) == (5000, 5000, 4321, text[4321], text[4321] ^ 1)
    assert tuple(pack.first_mismatch(a, c().where("g < 70"), block=64).first()) == (5000, 70, 70, text[70], None)
    assert pack.first_mismatch(a, _stream_of(spark, []), block=64).first().g == 0


def test_shard_difference_within_arrays(spark):
    rows = [("f", 0, "gpt-2", [1, 2, 3]), ("g", 0, "gpt-2", [1, 2, 4, 5]), ("h", 0, "gpt-2", [1, 2])]
    one = [spark.createDataFrame([r], "file string, shard int, model string, tokens array<long>") for r in rows]
    assert tuple(shards.diff(one[0], one[1]).first()) == (3, 4, 2) and tuple(shards.diff(one[0], one[2]).first()) == (3, 2, 2)
    assert tuple(shards.diff(one[0], one[0]).first()) == (3, 3, None)


def test_initializer_ranges_read_their_rows_only(spark, tmp_path, monkeypatch):
    rows = np.random.default_rng(1).standard_normal((20_000, 16)).astype("<f4")
    other = _field(1, 500_000) + _field(2, 1) + _field(8, b"big") + _field(9, bytes(2_000_000))
    packed = _field(1, 20_000) + _field(1, 16) + _field(2, 1) + _field(4, rows[:5].tobytes()) + _field(4, rows[5:].tobytes()) + _field(8, b"wte")
    path = tmp_path / "m.onnx"
    path.write_bytes(_field(1, 8) + _field(7, _field(5, other) + _field(5, packed)))
    monkeypatch.setattr(onnx_init, "NUMBERS", 16_000)
    parts = onnx_init.InitializerReader({"path": str(path), "tensor": "wte"}).partitions()
    assert len(parts) == 20 and parts[3].tensor.rows == 20_000
    taken = []

    class Counting(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

        def read_at(self, n, offset):
            taken.append(n)
            return bytes(self.getbuffer()[offset : offset + n])

    class Files:
        def open_input_file(self, _):
            return Counting(path.read_bytes())

    monkeypatch.setattr(onnx_init, "file_system", lambda p: (Files(), p))
    onnx_init.locate(str(path), "wte")
    assert sum(taken) <= 4 * onnx_init.Wire.BUFFER
    taken.clear()
    got = next(iter(onnx_init.InitializerReader({"path": str(path), "tensor": "wte"}).read(parts[0])))
    assert sum(taken) == 1000 * 64 and got.column(1)[4].as_py() == rows[4].tolist() and got.column(1)[999].as_py() == rows[999].tolist()
    monkeypatch.undo()
    assert onnx_init.read_initializer(spark, str(path), "wte").where("row = 19999").first().embedding == rows[19_999].tolist()
    path.write_bytes(path.read_bytes()[:-30])
    with pytest.raises(ValueError, match="within a field|other than"):
        onnx_init.initializer(str(path), "none")
