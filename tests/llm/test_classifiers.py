import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import quality, toxicity
from corpusmill.llm.common import text_buffers
from corpusmill.llm.labelled import class_counts, labelled_sample


def buffers(texts):
    return text_buffers(pa.array(texts, pa.string()))


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    texts, labels, langs = [], [], []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["idiot", "moron,", "vermi" + rng.choice("abcdefgh") + "x"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
        langs.append(rng.choice(["en", "de", None]))
    return texts, np.array(labels), langs


def test_toxicity_on_held_out_texts():
    texts, labels, langs = toxic_corpus(600, 1)
    net = toxicity.fit(*buffers(texts), labels, langs)
    more, want, _ = toxic_corpus(400, 2)
    got = toxicity.sigmoid(net.logits(*buffers(more))) >= 0.5
    assert (got == want).mean() > 0.97 and set(net.thresholds) == {"en", "de"}
    # a score belongs to its text alone, whatever it is scored with
    one = np.concatenate([net.logits(*buffers([t])) for t in more[:20]])
    assert np.allclose(one, net.logits(*buffers(more))[:20], atol=1e-5)


def test_network_against_plain_loops():
    """Filters over word vectors, their maxima over the text and the logistic layer, one window at a time."""
    texts, labels, langs = toxic_corpus(80, 3)
    net = toxicity.fit(*buffers(texts), labels, langs, epochs=2)
    for text in ["one idiot, here", "x", "", "word1 word2 word3 moron, word4", texts[0]]:
        vectors = []
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
            feats, where, _ = toxicity.word_types(*buffers([w.decode()]))
            vectors.append(sum(net.emb[f].astype(float) for f in feats[where[0]]))
        vectors += [np.zeros(toxicity.DIM)] * toxicity._PAD  # the end of a text is padding
        z = net.out[-1] - net.shift
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                sums = [sum(float(vectors[i + j] @ net.conv[k][j][:, f]) for j in range(width)) for i in range(len(vectors) - toxicity._PAD)]
                top = max([*sums, 0.0])  # padding starts a window of nothing
                z += max(top + net.bias[k * toxicity.FILTERS + f], 0) * net.out[k * toxicity.FILTERS + f]
        assert net.logits(*buffers([text]))[0] == pytest.approx(z, abs=1e-4)


def quality_corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(300)]
    texts, labels = [], []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(4, 120))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [w[k // 10 * 10] for k in range(len(w))] + [w[0]] * 9 if kind == 1 else [x + rng.choice(["***", "$$$"]) for x in w]
        texts.append(" ".join(w) + ".")
        labels.append(int(not bad))
    return texts, np.array(labels)


def test_quality_on_held_out_texts():
    texts, labels = quality_corpus(600, 1)
    m = quality.fit(*buffers(texts), labels)
    more, want = quality_corpus(400, 2)
    got = quality.sigmoid(m.logits(*buffers(more))) >= 0.3
    assert (got == want).mean() > 0.97


def test_sum_of_squares_identity():
    """The score is that of all pairs of features, summed one by one."""
    texts, labels = quality_corpus(80, 3)
    m = quality.fit(*buffers(texts), labels, epochs=2)
    data, offs = buffers(["word1 word2 word2 word7"])
    bucket, first, stats, meta = quality.features(data, offs)
    x = m.standard(stats)[0]
    feats = [(m.word[b].astype(float), 1 / len(bucket)) for b in bucket] + [(m.stat[k], x[k]) for k in range(quality.N_STATS)] + [(m.meta[meta[0]], 1.0)]
    z = m.bias + sum(v[0] * w for v, w in feats)
    z += sum(feats[i][1] * feats[j][1] * float(feats[i][0][1:] @ feats[j][0][1:]) for i in range(len(feats)) for j in range(i))
    assert m.logits(data, offs)[0] == pytest.approx(z, rel=1e-4)


def test_samples_leave_out_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"t{k}", None) for k in range(200)] + [(None, "x", None)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(200)] + [(3, 1, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    t = labelled_sample(docs, labels, "toxic", 30).toArrow()
    ids = [int(x[1:]) for x in t.column("text").to_pylist()]
    assert len(ids) == 60 and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and sorted(set(t.column("label").to_pylist())) == [0, 1]
    assert class_counts(labels, "toxic")[0] == sum(1 for k in range(0, 200, 2) if zlib.crc32(str(k).encode()) % 5)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    texts, labels = toxic_corpus(60, 5)[:2]
    model = module.fit(*buffers(texts), labels)
    df = spark.createDataFrame([(1, None, 0.1, "e"), (2, "", 0.1, None), (3, "word1 " * 30000, 0.1, "en"), (3, "word1 " * 30000, 0.1, "en"), (None, "x", 0.1, "en")], "doc_id long, text string, score double, lang string")
    rows = module.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2]
    assert module.score(df.limit(0), model).count() == 0
    for y in (np.zeros(0, np.int64), np.ones(2, np.int64)):  # no rows, or one class
        one = module.fit(*buffers(["a b", "c"][: len(y)]), y)
        assert np.isfinite(one.logits(*buffers(["a", ""]))).all()


def test_keep_good_keeps_all_columns(spark):
    texts, labels = quality_corpus(200, 7)
    m = quality.fit(*buffers(texts), labels)
    df = spark.createDataFrame([(k, t, "s", None) for k, t in enumerate(texts)], "doc_id long, text string, __text string, score array<int>")
    kept = quality.keep_good(df, m)
    assert kept.columns == df.columns
    good = quality.sigmoid(m.logits(*buffers(texts))) >= 0.3
    assert sorted(r.doc_id for r in kept.collect()) == np.flatnonzero(good).tolist()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_empty_tables(spark, module):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for d in (docs, docs.limit(0)):
        model = module.fit_labelled(d, labels)
        assert module.score(d, model).count() == d.count()


def test_samples_are_bounded_by_rows_and_bytes(spark):
    """Also where one labelled id has very many rows, or long texts."""
    docs = spark.createDataFrame([(k % 40, "x" * 100) for k in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    count = lambda **kw: {r.label: r["count"] for r in labelled_sample(docs, labels, "toxic", **kw).groupBy("label").count().collect()}
    assert count(per_class=30) == {0: 30, 1: 30}
    assert count(per_class=1000, class_bytes=2500) == {0: 25, 1: 25}


def test_thresholds_are_those_of_all_labelled_rows(spark):
    """The sample is even between the classes, the table is not, and the classes overlap."""
    rng = random.Random(9)
    rows = []
    for k in range(4000):
        bad = rng.random() < 0.05
        w = [f"word{rng.randrange(50)}" for _ in range(12)] + ["idiot"] * (rng.random() < (0.8 if bad else 0.15)) + ["moron"] * (rng.random() < (0.5 if bad else 0.02))
        rows.append((k, " ".join(w), rng.choice(["en", "de", None]), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    net = toxicity.fit_labelled(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"), per_class=100)
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    raw, label = net.logits(*buffers([r[1] for r in rows])), np.array([r[3] for r in rows])

    def f1(flagged, y):
        return 2 * (flagged & (y == 1)).sum() / (flagged.sum() + y.sum())

    def best(s, y):
        return max(f1(s >= x, y) for x in s)

    assert f1(raw >= 0, label) >= best(raw, label) - 0.005
    assert set(net.thresholds) == {"en", "de"}
    for name, limit in net.thresholds.items():
        own = np.array([r[2] == name for r in rows])
        assert f1(toxicity.sigmoid(raw[own]) >= limit, label[own]) >= best(raw[own], label[own]) - 0.005
