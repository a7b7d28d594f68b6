import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bias, embed, evaluate, lookup, model, quantiles, score
from corpusmill.operators.windows import WindowConfig, jobs, token_windows
from corpusmill.plans.progress import ProgressBar, job_progress
from corpusmill.streaming import windows as streaming


def context(spark):
    return spark.createDataFrame([(1, 10, -1.0, 1), (1, 11, -2.0, 2), (1, 12, -4.0, 3)], "uid int, token int, logprob float, pos int")


def test_first_match_takes_precedence(spark):
    r = spark.createDataFrame([(10, 11, 100), (11, 12, 101)], "a int, b int, c int")
    s = bias.summed(bias.matched(bias.pairs(context(spark)), r), 100, None)
    assert {(x.tok, x.pos): x.token_logprob for x in s.collect()} == {(100, 1): -1.0, (101, 2): -6.0}
    p = bias.peek(context(spark), r, 100).orderBy("pos").collect()
    assert [(x.tok_a, x.tok_b, x.tok_c, x.logprob_a, x.logprob_b) for x in p] == [(10, 11, 100, -1.0, -2.0), (11, 12, 101, -2.0, -4.0)]
    v = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z"), (100, "xy"), (101, "yz")], "id int, token string")
    n = bias.peek_named(bias.peek(context(spark), r, 100, 1), v).first()
    assert (n.text_a, n.text_b, n.text_c, n.logprob_sum) == ("x", "y", "xy", -3.0)


def test_rules(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "ab"), (3, "abb")], "id long, token string")
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "b")], "rank int, left string, right string")
    r = bias.rules(merges, vocab, vocab.where("id < 3").select("token"))
    assert [(x.a, x.b, x.c, x.valid) for x in r.orderBy("rank").collect()] == [(0, 1, 2, True), (2, 1, 3, False)]
    final, counts = bias.extract(bias.rules(merges, vocab), 3, None)
    assert tuple(counts.first()) == (2, 1, 1) and [x.c for x in final.collect()] == [3]
    assert tuple(bias.extract(bias.rules(merges, vocab), 3, 1)[1].first()) == (2, 1, 1)
    with pytest.raises(Exception, match="no token"):
        bias.rules(spark.createDataFrame([(0, "a", "z")], "rank int, left string, right string"), vocab).collect()


def test_results_and_discontinuity(spark):
    s = spark.createDataFrame([(k % 3, t, k, -float(t + k % 3)) for t in (1, 2, 3, 5, 6, 7) for k in range(4)], "uid int, tok int, pos int, token_logprob double")
    r = bias.results(s, 4)
    rows = {x.tok: x for x in r.collect()}
    v = [-1.0, -2.0, -3.0, -1.0]
    assert rows[1].num == 4 and rows[1].median == np.quantile(v, 0.5) and rows[1].iqr == pytest.approx(np.quantile(v, 0.75) - np.quantile(v, 0.25)) and rows[1].std == pytest.approx(np.std(v, ddof=1))
    assert [(x.side, x.tokens, x.samples) for x in bias.sides(r).collect()] == [("left", 3, 12), ("right", 3, 12)]
    d = bias.delta(r, 4).first()
    assert d["diff"] == pytest.approx(0) and d["left"] == pytest.approx(-4.75)
    assert bias.delta(r.where("treat"), 4).first()["right"] is None
    assert bias.delta_text(-1, -2) == "left: -1.000000\nright: -2.000000\ndiff: -1.000000\n"
    assert {(x.treat, x.x_from, x.x_to) for x in bias.lines(r, 4).collect()} == {(True, 1, 3), (False, 4, 7)}
    assert bias.points(r, low=-5).count() == 3


def test_scores(spark):
    tokens = spark.createDataFrame([(0, [1, 2, 1, 2, 3]), (1, [2, 1])], "doc long, tokens array<int>")
    each = score.exploded(tokens)
    u = {r.token: r.logprob for r in score.unigram(each).collect()}
    assert u[1] == pytest.approx(math.log(3 / 7)) and u[3] == pytest.approx(math.log(1 / 7))
    b = score.bigram(score.pair_counts(each), 4, 0.1)
    got = {(r.prev, r.token): r.logprob for r in b.collect()}
    assert got[1, 2] == pytest.approx(math.log(2.1 / 2.4)) and got[2, 1] == pytest.approx(math.log(2.1 / 3.4))
    p = evaluate.perplexity(evaluate.unigram_scores(each, WindowConfig(4, 2, True))).first()
    assert tuple(evaluate.unigram_perplexity(each, WindowConfig(4, 2, True)).first()) == pytest.approx(tuple(p), rel=1e-6)
    assert p.n == 5 and p.ppl == pytest.approx(math.exp(-(u[2] * 2 + u[1] * 2 + u[3]) / 5))
    scorer = score.Bigram(b)
    assert scorer.generate([1], 3) == [2, 1, 2]
    with pytest.raises(ValueError):
        scorer.generate([], 1)
    w = jobs(token_windows(tokens, WindowConfig(4, 2, True)))
    rows = score.evaluate(w, scorer, lambda df: df).collect()
    flat = {(r.doc, r.start + r.seen + r.i): r.logprob for r in rows}
    want = {(r.uid, r.pos): r.logprob for r in evaluate.context(tokens, WindowConfig(4, 2, True), 4, 0.1).collect()}
    assert flat == want and len(rows) == 5


def test_arrow_scorer(spark):
    tokens = spark.createDataFrame([(0, [3, 5, 7, 9]), (1, [2])], "doc long, tokens array<int>")
    s = score.ArrowScorer(lambda: lambda x: -(x[:, 1:] + x[:, :-1]).astype(float), batch=1)
    w = jobs(token_windows(tokens, WindowConfig(3, 3, True, pad_right=True)))
    rows = score.aligned(s.score(w)).orderBy("doc", "start", "i").collect()
    assert [(r.doc, r.token, r.logprob) for r in rows] == [(0, 5, -8.0), (0, 7, -12.0)]


@pytest.mark.parametrize("pads", [{}, {"pad_left": True}, {"pad_right": True}])
def test_dense_scorer_equals_the_joined_model(spark, pads):
    """Also for tails shorter than what is seen, documents of one token, none, or null."""
    docs = [(k, [(k * 5 + j * j) % 11 for j in range(n)]) for k, n in enumerate([0, 1, 2, 3, 7, 8, 9, 40])]
    tokens = spark.createDataFrame([*docs, (99, None)], "doc long, tokens array<int>")
    c = WindowConfig(4, 3, True, pad_token=10, **pads)
    table = score.bigram(score.pair_counts(score.exploded(tokens)), 11, 0.1)
    rows = score.evaluate(jobs(token_windows(tokens, c)), score.dense_bigram(table, 11, batch=2), lambda df: df).collect()
    got = sorted((r.doc, r.start + r.seen + r.i, r.token, r.logprob) for r in rows)
    assert got == sorted((r.uid, r.pos, r.token, r.logprob) for r in evaluate.context(tokens, c, 11, 0.1).collect()) and len(got) > 50
    with pytest.raises(ValueError, match="too many tokens"):
        score.dense_bigram(table, score.DENSE + 1)


def test_large_lookup_tables_are_not_broadcast(spark, monkeypatch):
    tokens = spark.createDataFrame([(d, [1, 2, 1, d % 3, 3]) for d in range(30)], "doc long, tokens array<int>")
    rows = lambda: sorted(map(tuple, evaluate.context(tokens, WindowConfig(4, 2, True), 4).collect()))
    small = rows()
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    assert rows() == small
    hint = lambda most: "broadcast" in lookup.sized(spark.range(3), most)._jdf.queryExecution().analyzed().toString()
    assert hint(3) and not hint(2)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def proto(number, payload):
    return varint(number << 3) + varint(payload) if isinstance(payload, int) else varint(number << 3 | 2) + varint(len(payload)) + payload


def onnx_value(name, kind, *dims):
    shape = b"".join(proto(1, proto(1, d) if isinstance(d, int) else proto(2, d.encode())) for d in dims)
    return proto(1, name) + proto(2, proto(1, proto(1, kind) + proto(2, shape)))


def onnx_node(op, inputs, output, **numbers):
    attributes = b"".join(proto(5, proto(1, k.encode()) + proto(3, v) + proto(20, 2)) for k, v in numbers.items())
    return b"".join(proto(1, x) for x in inputs) + proto(2, output) + proto(4, op) + attributes


def onnx_tensor(name, values):
    kind = 1 if values.dtype == np.dtype("<f4") else 7
    return b"".join(proto(1, n) for n in values.shape) + proto(2, kind) + proto(8, name) + proto(9, values.tobytes())


def onnx_file(path, nodes, tensors, inputs, outputs):
    parts = [(1, nodes), (2, [b"g"]), (5, tensors), (11, inputs), (12, outputs)]
    graph = b"".join(proto(number, x) for number, xs in parts for x in xs)
    path.write_bytes(proto(1, 8) + proto(8, proto(1, b"") + proto(2, 13)) + proto(7, graph))


def onnx_bigram(path, table):
    """A model file of one Gather: the logits after a token are a row of ``table``."""
    node = onnx_node(b"Gather", [b"rows", b"input_ids"], b"logits")
    onnx_file(path, [node], [onnx_tensor(b"rows", table)], [onnx_value(b"input_ids", 7, "n", "t")], [onnx_value(b"logits", 1, "n", "t", "v")])


def test_generation_with_a_cache(tmp_path):
    """The cache holds all tokens so far, and logits prefer the next id to what is in the cache last."""
    table = np.full((10, 10), -1, "<f4")
    for k in range(10):
        table[k, [(k + 3) % 10, (k + 7) % 10]] = 1  # ties go to the smaller id
    nodes = [
        onnx_node(b"Cast", [b"input_ids"], b"floats", to=1), onnx_node(b"Reshape", [b"floats", b"shape"], b"new"),
        onnx_node(b"Concat", [b"past.0.key", b"new"], b"present.0.key", axis=2), onnx_node(b"Gather", [b"rows", b"input_ids"], b"logits"),
    ]
    tensors = [onnx_tensor(b"rows", table), onnx_tensor(b"shape", np.array([1, 1, -1, 1], "<i8"))]
    cache = lambda name: onnx_value(name, 1, 1, 1, "past" if name.startswith(b"past") else "all", 1)
    onnx_file(tmp_path / "m.onnx", nodes, tensors, [onnx_value(b"input_ids", 7, 1, "t"), cache(b"past.0.key")], [onnx_value(b"logits", 1, 1, "t", 10), cache(b"present.0.key")])
    m = model.CachedModel.from_file(str(tmp_path / "m.onnx"), model.ModelShape(layers=1, heads=1, head_size=1, positions=12, vocabulary=10))
    got = m.generate([4, 1], 5)
    want, last = [], 1
    for _ in range(5):
        last = min((last + 3) % 10, (last + 7) % 10)
        want.append(last)
    assert got == want and m.cache[0].ravel().tolist() == [4, 1, *want[:-1]] and m.seen == 6
    for prompt, steps in (([], 1), ([1] * 8, 5)):
        with pytest.raises(ValueError):
            m.generate(prompt, steps)
    x = model.input_arrays(np.array([[5, 6]]), past=3)
    assert x["position_ids"].tolist() == [[3, 4]] and x["attention_mask"].shape == (1, 5)
    assert (model.GPT2.width, model.GPT2_LARGE.width, model.GPT2.empty_cache().shape) == (768, 1280, (1, 12, 0, 64))
    onnx_bigram(tmp_path / "b.onnx", table)
    with pytest.raises(ValueError, match="cache"):
        model.CachedModel.from_file(str(tmp_path / "b.onnx"), model.GPT2).generate([1], 1)


def test_onnx_scorer(spark, tmp_path):
    """A model file is scored window by window: log-probabilities are those of its logits."""
    rng = np.random.default_rng(3)
    table = rng.normal(size=(12, 12)).astype("<f4")
    onnx_bigram(tmp_path / "m.onnx", table)
    logp = table - np.log(np.exp(table).sum(axis=1, keepdims=True))
    docs = [(d, rng.integers(0, 12, n).tolist()) for d, n in ((0, 9), (1, 1), (2, 4), (3, 23))]
    tokens = spark.createDataFrame(docs, "doc long, tokens array<int>")
    w = jobs(token_windows(tokens, WindowConfig(6, 3, True)))
    rows = score.evaluate(w, score.onnx_scorer(str(tmp_path / "m.onnx"), batch=2), lambda df: df).collect()
    got = {(r.doc, r.start + r.seen + r.i): r.logprob for r in rows}
    want = {(d, k): logp[t[k - 1], t[k]] for d, t in docs for k in range(1, len(t))}
    assert len(rows) == len(want) and set(got) == set(want) and all(got[x] == pytest.approx(want[x], abs=1e-5) for x in want)


def test_embeddings(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [2.0, 2.0])], "token_id int, embedding array<float>")
    f = embed.flagged(e, e.where("token_id < 2").select("token_id"))
    assert [list(r.vec) for r in embed.centroid(f).collect()] == [[2.0, 2.0]]
    assert {r.token_id: round(r.distance, 4) for r in embed.distances(f).collect()} == {0: 2.2361, 1: 2.2361, 2: 0.0}
    assert [r.reference for r in embed.with_reference(embed.distances(f), f).collect()] == [True, True, False]
    assert embed.centroid(f.where("token_id > 5")).first().vec is None


def test_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two three four\nfive")
    (tmp_path / "b.txt").write_text("one two")
    docs = streaming.stream_texts(spark, str(tmp_path))
    q = streaming.to_memory(streaming.stream_windows(docs, WindowConfig(3, 2, True)), "w")
    q.processAllAvailable()
    q.stop()
    assert [(r.doc, r.n) for r in spark.table("w").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).orderBy("doc").collect()] == [("a.txt", 3), ("b.txt", 1)]
    q = streaming.to_memory(streaming.running_dictionary(docs), "d", "complete")
    q.processAllAvailable()
    q.stop()
    assert {r.piece: r.cnt for r in spark.table("d").collect()}["one"] == 2


def test_progress(spark):
    b = ProgressBar(10, 5, 4)
    assert str(b).startswith("[==> ]  50% 5/10")
    b.add(5)
    assert b.progress == 1 and ProgressBar().progress == 0
    b.finish()
    assert job_progress(spark).progress == 0


@pytest.mark.parametrize("stretch", [1, 3, 10, 1000])
def test_neighbours_across_stretches(spark, stretch):
    """As one window over each document would find them: gaps, documents of one row, stretches without a row, negative positions."""
    rng = np.random.default_rng(stretch)
    rows = [(int(u), int(p), int(rng.integers(0, 5)), float(p)) for u in range(12) for p in sorted(rng.choice(np.arange(-40, 90), rng.integers(0, 40), replace=False))]
    rows += [(None, 4, 1, 1.0), (None, 9, 2, 1.0), (77, 5000, 3, 1.0)]
    df = spark.createDataFrame(rows, "uid int, pos int, token int, logprob double")
    want = sorted(map(str, bias.pairs(df, longest=0, stretch=10**6).collect()))
    got = bias.pairs(df, stretch=stretch)
    assert sorted(map(str, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Initial Plan")].count("REPARTITION_BY_COL") == 2 and "ReusedExchange" in plan  # one exchange of rows, read twice


@pytest.mark.parametrize("ranges", [2, 5, 128])
def test_quantiles_by_ranges_equal_percentile(spark, ranges):
    """Ties, one row, one value, two values, nulls, skew, infinite values."""
    rng = np.random.default_rng(ranges)
    groups = {1: rng.standard_normal(501), 2: [4.0], 3: [1.0] * 300, 4: [1.0, 2.0], 5: rng.integers(0, 4, 400), 6: 10.0 ** rng.integers(-30, 30, 250), 7: [-0.5, None, 0.5, None], 8: [float("-inf"), 0.0, 1.0]}
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double")
    ps = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("q")).collect()}
    got = {r.g: r.q for r in quantiles.selected(df, "g", "v", ps, ranges).collect()}
    assert got == want and len(got) == 8
    counts = df.groupBy("g").agg(F.count(F.lit(1)).alias("num"))
    for light in (0, 299, 10**6):
        assert {r.g: r.q for r in quantiles.quantiles(df, counts, "g", "v", ps, light).collect()} == want


def test_hot_tokens_of_the_experiment(spark):
    rows = [(u, tok, p, float((u * 7 + p) % 13) - 20) for u in range(40) for p, tok in enumerate([5, 5, 5, 6, 9])]
    s = spark.createDataFrame(rows, "uid int, tok int, pos int, token_logprob double")
    plain, hot = ({r.tok: tuple(r) for r in bias.results(s, 6, light).collect()} for light in (10**6, 50))
    assert len(plain) == 3 and all(hot[k] == pytest.approx(v) for k, v in plain.items())
