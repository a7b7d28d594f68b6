"""Work on documents that are whole in a row equals the work on rows of tokens, and shuffles no token."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import batches, bytelevel, pretok
from corpusmill.operators import bias, dense, evaluate, score
from corpusmill.operators.windows import WindowConfig, jobs, token_windows

V = 7
CONFIGS = [WindowConfig(4, 2), WindowConfig(4, 4, True), WindowConfig(5, 3, True), WindowConfig(6, 2), WindowConfig(4, 2, True, pad_left=True), WindowConfig(5, 4, True, pad_right=True)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [int(x) for x in rng.integers(0, V, n)]) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 9, 30, 31, 32, 33])]
    return spark.createDataFrame([*rows, (77, None)], "doc long, tokens array<int>")


def digest(rows):
    return hashlib.md5(",".join(":".join(map(str, r)) for r in sorted(rows)).encode()).hexdigest()


def by_doc(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r["uid"], []).append(tuple(-1 if r[c] is None else r[c] for c in columns))
    return {u: (len(x), digest(x)) for u, x in out.items()}


def told(df):
    return {r.uid: (r.n, r.digest) for r in df.collect()}


def no_rows_shuffled(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan and "Generate" not in plan


def test_pair_counts(docs):
    want = sorted(map(tuple, score.pair_counts(score.exploded(docs)).collect()))
    assert sorted(map(tuple, dense.pair_counts(docs, V).collect())) == want
    with pytest.raises(Exception, match="outside"):
        dense.pair_counts(docs, V - 1).collect()
    with pytest.raises(ValueError, match="too many"):
        dense.pair_counts(docs, score.DENSE + 1)


@pytest.mark.parametrize("c", CONFIGS)
def test_context_and_windows(docs, c):
    counts = score.pair_counts(score.exploded(docs))
    rows = evaluate.context(docs, c, V, 0.1, counts).collect()
    x = dense.Experiment(docs, c, score.bigram(counts, V, 0.1), V)
    got = x.context()
    assert no_rows_shuffled(got) and told(got) == by_doc(rows, "pos", "token") and len(rows) > 50
    sums = {}
    for r in rows:
        sums[r.uid] = sums.get(r.uid, 0) + r.logprob
    assert {r.uid: r.logprob for r in got.collect()} == pytest.approx(sums)
    wins = x.windows({"a": c})
    assert no_rows_shuffled(wins) and told(wins) == told(got)
    rows = score.evaluate(jobs(token_windows(docs, c)), score.Bigram(score.bigram(counts, V, 0.1)), lambda d: d.selectExpr("doc AS uid", "start + seen + i AS pos", "token"))
    assert told(wins) == by_doc(rows.collect(), "pos", "token")


@pytest.mark.parametrize("window", [None, 3])
@pytest.mark.parametrize("c", [WindowConfig(4, 2), WindowConfig(4, 4, True)])
def test_experiment(spark, docs, c, window):
    """Pairs, matches, rewritten sums, their counts, results, and what is shown of merges; rules that overlap, too."""
    counts = score.pair_counts(score.exploded(docs))
    rules = spark.createDataFrame([(1, 2, 7), (2, 3, 8), (3, 3, 9), (0, 1, 10), (4, 9, 11)], "a int, b int, c int")
    context = evaluate.context(docs, c, V, 0.1, counts)
    x = dense.Experiment(docs, c, score.bigram(counts, V, 0.1), V, rules, V, window)
    p = bias.pairs(context)
    m = bias.matched(p, rules)
    assert told(x.pairs()) == by_doc(p.collect(), "pos", "token", "next_tok", "prev_tok")
    assert told(x.matched()) == by_doc(m.collect(), "pos", "merged_as_first", "merged_as_second")
    s = bias.summed(m, V, window)
    assert told(x.summed()) == by_doc(s.collect(), "pos", "tok")
    assert all(no_rows_shuffled(d) for d in (x.pairs(), x.matched(), x.summed()))
    want = {(r.tok, round(r.token_logprob, 9)): r.n for r in s.groupBy("tok", "token_logprob").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r.tok, round(r.token_logprob, 9)): r.n for r in x.sums().collect()} == want
    key = lambda r: r.tok
    for a, b in zip(sorted(bias.counted_results(x.sums(), V).collect(), key=key), sorted(bias.results(s, V).collect(), key=key), strict=True):
        assert tuple(a) == pytest.approx(tuple(b))
    assert sorted(map(tuple, x.peek().collect())) == sorted(map(tuple, bias.peek(context, rules, V).select(*x.peek().columns).collect()))
    for n in (1, 5):
        assert list(map(tuple, x.peek(n).collect())) == sorted(map(tuple, x.peek().collect()))[:n]
    with pytest.raises(ValueError, match="two rules"):
        dense.rule_table(rules.union(rules), V)


def test_results_are_those_of_rows(spark):
    """Counted sums against plain aggregates: one row, equal values, nulls, tokens with more values than one task takes."""
    rng = np.random.default_rng(2)
    rows = [(t, None if t == 4 or rng.random() < 0.1 else float(v)) for t in (1, 2, 3, 4) for v in rng.integers(0, 40, 300)] + [(9, 2.5)]
    s = spark.createDataFrame(rows, "tok int, token_logprob double")
    ps = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    want = {r.tok: (*(r.q or [None] * 3), r.m, r.s, r.n) for r in s.groupBy("tok").agg(F.percentile("token_logprob", ps).alias("q"), F.avg("token_logprob").alias("m"), F.stddev_samp("token_logprob").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    for light in (10**6, 10):
        got = {r.tok: (r.q25, r.median, r.q75, r["mean"], r["std"], r.num) for r in bias.results(s, 3, light).collect()}
        assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in want)


def test_lists_leave_in_small_batches():
    """Whatever the size of a batch: the lists of bytes are four times as large."""
    texts = [b"x" * 90_000, None, b"", b"ab", b"y" * 700_000, *[b"z" * 9_000] * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc", "raw"])
    for b in (batch, batch.slice(1, 150)):
        out = list(pretok.listed(b, "raw", "tokens"))
        lens = [[len(x) for x in o["tokens"].to_pylist()] for o in out]
        assert all(sum(x) <= batches.SLICE or len(x) == 1 for x in lens) and len(out) > 3
        assert [d for o in out for d in o["doc"].to_pylist()] == b["doc"].to_pylist()
        assert [bytes(x) for o in out for x in o["tokens"].to_pylist()] == [x or b"" for x in b["raw"].to_pylist()]


def test_symbols_of_long_batches(spark):
    texts = [bytes(range(256)), None, b"", b"a \xff\x00" * 150_000, "é".encode()]
    df = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(texts)], "k int, raw binary").coalesce(1)
    got = {r.k: r.s for r in df.select("k", bytelevel.mapped(F.col("raw")).alias("s")).collect()}
    assert got == {k: None if t is None else bytelevel.to_symbols(t) for k, t in enumerate(texts)}


def test_flat_rows():
    lists = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    for column, want in ((lists, ([1, 2, 3], [0, 2, 2, 2, 3])), (lists.slice(1), ([3], [0, 0, 0, 1])), (pa.array([b"ab", None, b"c"]), ([97, 98, 99], [0, 2, 2, 3]))):
        values, offs = batches.flat(column)
        assert (values.tolist(), offs.tolist()) == want
