import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.windows import WindowConfig, chunk_offsets, chunked_windows, jobs, scored_positions, token_windows


def run(spark, docs, c):
    df = spark.createDataFrame([(k, list(t.encode())) for k, t in enumerate(docs)], "doc long, tokens array<int>")
    return [(r.doc, r.position, r.start, bytes(r.tokens).decode(), r.seen, r.pad_left, r.pad_right) for r in token_windows(df, c).orderBy("doc", "position").collect()]


def texts(rows):
    return [r[3].replace("\0", "0") for r in rows]


@pytest.mark.parametrize(
    ("w", "s", "kw", "text", "want"),
    [
        (5, 5, {}, "abcdefghij", ["abcde", "fghij"]),
        (4, 2, {}, "abcdef", ["abcd", "cdef"]),
        (10, 5, {}, "abcde", []),
        (4, 4, {}, "abcd", ["abcd"]),
        (5, 5, {"tail": True}, "abcdef", ["abcde", "f"]),
        (4, 2, {"tail": True}, "abcdefgh", ["abcd", "cdef", "efgh", "gh"]),
        (4, 2, {"tail": True, "pad_left": True}, "abcdefg", ["abcd", "cdef", "0efg"]),
        (4, 2, {"tail": True, "pad_right": True}, "abcdefg", ["abcd", "cdef", "efg0"]),
    ],
)
def test_golden(spark, w, s, kw, text, want):
    assert texts(run(spark, [text], WindowConfig(w, s, **kw))) == want


def test_positions_and_seen(spark):
    rows = run(spark, ["abcdefgh"], WindowConfig(4, 2, True))
    assert [r[2] for r in rows] == [0, 2, 4, 6] and [r[4] for r in rows] == [0, 2, 2, 2]
    assert run(spark, ["abcdefg"], WindowConfig(4, 2, True, pad_left=True))[-1][4:] == (2, 1, 0)
    assert run(spark, ["abcde", "", "fghij"], WindowConfig(10, 10, True)) == [(0, 0, 0, "abcde", 0, 0, 0), (2, 0, 0, "fghij", 0, 0, 0)]


def test_bad_configurations():
    for kw in ({"window": 4, "stride": 5}, {"pad_left": True, "pad_right": True}, {"window": 0}, {"stride": 0}):
        with pytest.raises(ValueError):
            WindowConfig(**{"window": 4, "stride": 2, **kw})


def simulate(n, w, s, tail):
    """Push tokens one at a time: (start, length, seen)."""
    out, start = [], 0
    while start + w <= n:
        out.append((start, w, min(start, w - s)))
        start += s
    if tail and start < n:
        out.append((start, n - start, min(start, n - start, w - s)))
    return out


def test_closed_form_and_scored_positions(spark):
    rng = random.Random(3)
    for _ in range(12):
        w = rng.randint(1, 12)
        s, tail = rng.randint(1, w), rng.random() < 0.5
        c = WindowConfig(w, s, tail)
        sizes = list(range(0, 40, 3))
        df = spark.createDataFrame([(n, list(range(n))) for n in sizes], "doc long, tokens array<int>")
        got = {}
        for r in token_windows(df, c).collect():
            got.setdefault(r.doc, []).append((r.start, len(r.tokens), r.seen))
        each = df.select("doc", F.size("tokens").alias("length"), F.posexplode("tokens").alias("pos", "token"))
        scored = {}
        for r in scored_positions(each, c).collect():
            scored.setdefault(r.doc, []).append((r.position, r.pos))
        for n in sizes:
            want = simulate(n, w, s, tail)
            assert sorted(got.get(n, [])) == want
            hits = [(k, a + i) for k, (a, length, seen) in enumerate(want) for i in range(max(seen, 1), length)]
            assert sorted(scored.get(n, [])) == sorted(hits)
            if tail and w <= 2 * s and s < w and n:
                assert sorted(p for _, p in hits) == list(range(1, n))


def test_dedupe_and_jobs(spark):
    df = spark.createDataFrame([(0, 20, p) for p in range(20)], "doc long, length int, pos int")
    rows = [r.pos for r in scored_positions(df, WindowConfig(8, 2, True), dedupe=True).collect()]
    assert len(rows) == len(set(rows))
    w = spark.createDataFrame([(0, [1, 2, 3])], "doc long, tokens array<int>")
    assert [r.seen for r in jobs(token_windows(w, WindowConfig(2, 1, True))).orderBy("position").collect()] == [1, 1, 1]


@pytest.mark.parametrize("seed", range(6))
def test_chunks_give_the_windows_of_whole_documents(spark, seed):
    """For any cut: empty chunks, chunks shorter than a stride and longer than a stretch, gaps in their numbers."""
    rng = random.Random(seed)
    w = rng.randint(1, 12)
    pads = rng.choice([{}, {"pad_left": True}, {"pad_right": True}])
    c = WindowConfig(w, rng.randint(1, w), rng.random() < 0.7, **pads)
    docs, chunks = [], []
    for doc in [*range(25), None]:
        tokens = [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, w, 40, 200]))]
        docs.append((doc, tokens))
        at = order = 0
        while at < len(tokens) or rng.random() < 0.3:
            n = rng.choice([0, 1, 2, 7, 90])
            chunks.append((doc, order, tokens[at : at + n] or rng.choice([[], None])))
            at, order = at + n, order + rng.choice([1, 1, 5000])
    rng.shuffle(chunks)
    whole = token_windows(spark.createDataFrame(docs, "doc long, tokens array<int>"), c)
    cut = chunked_windows(spark.createDataFrame(chunks, "doc long, chunk long, tokens array<int>"), c, stretch=rng.choice([1, 30, 1000]))
    assert cut.columns == whole.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    raw = spark.createDataFrame([(d, o, None if t is None else bytes(t)) for d, o, t in chunks], "doc long, chunk long, raw binary")
    of_bytes = chunked_windows(raw, c, tokens="raw", stretch=rng.choice([1, 30, 1000]))
    assert of_bytes.columns == whole.columns
    assert sorted(map(str, of_bytes.collect())) == sorted(map(str, whole.collect()))


def test_pushes_of_the_reference_cases(spark):
    rows = [(0, 0, list(b"ab")), (0, 1, list(b"cd"))]
    df = spark.createDataFrame(rows, "doc long, chunk long, tokens array<int>")
    assert [bytes(r.tokens) for r in chunked_windows(df, WindowConfig(4, 4)).collect()] == [b"abcd"]
    assert chunked_windows(df.limit(0), WindowConfig(4, 4)).count() == 0
    at = chunk_offsets(spark.range(20_000).select(F.lit(1).alias("d"), F.col("id").alias("k")), "d", "k", F.lit(3), block=64)
    assert at.where("at <> order * 3 or total <> 60000").count() == 0


def test_a_long_document_is_many_rows_of_bounded_size(spark):
    df = spark.range(400).select(F.floor(F.col("id") / 400).alias("doc"), F.col("id").alias("chunk"), F.array_repeat(F.lit(7), 1000).alias("tokens"))
    got = chunked_windows(df, WindowConfig(512, 256), stretch=4096)
    assert got.count() == (400_000 - 512) // 256 + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc#\d+L?, stretch#\d+L", plan)
