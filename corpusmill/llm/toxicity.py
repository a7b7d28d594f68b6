"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first letters; filters of
several widths run over the words, each filter is max-pooled over the whole text, and a logistic layer
reads the pools. Training goes back through the maxima only. Thresholds are calibrated by language on
all labelled rows that are not held out, whatever part of them the network is trained on, so they follow
the classes' share of the table: the score itself never sees a language; its logit is shifted so that 0.5
is the best threshold over all languages.

Defined results: a null or empty text has no words and gets the score of an empty text; every row has its
score, also rows that repeat and rows without an id (which are never learnt from); a null language has the threshold
0.5; an empty table gives an empty table, and without labels of both classes every score is the labels'
smoothed share; further columns, whatever their names, do not matter; a long text is a slice of work of its own, read whole.
Words are runs of letters, digits and bytes of non-ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batches, held_out
from .labelled import PER_CLASS, Spans, best_f1, fit_on_executor, known_labels, labelled_sample, sigmoid, sliced, table_buffers

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of a word's beginning that have an embedding of their own.
PREFIXES = (3, 4, 5, 6)
#: Bytes of text that are scored at once: a window of words has a number for each filter.
PIECE_BYTES = 1 << 19
#: Steps of a logit, from -30 to 30, that scores of many rows are counted by for thresholds.
STEPS = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PAD = max(WIDTHS) - 1


def word_types(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets of each distinct word, the distinct word of each position, first position of
    each document). Row 0 is padding; every document ends in padding."""
    n, docs = len(data), len(offs) - 1
    if n:
        letter = _LETTER[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        cut = offs[1:-1]
        before[cut[cut < n]] = False
        after[cut[cut > 0] - 1] = False
        starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    first = np.searchsorted(starts, offs)
    spans = Spans(data)
    h = spans(starts, ends)
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    cols = [h[at], *(spans(s, np.minimum(s + k, e), k) for k in PREFIXES)]
    feats = np.zeros((len(at) + 1, len(cols)), np.int32)
    for k, c in enumerate(cols):
        feats[1:, k] = 1 + (c % U(BUCKETS - 1)).astype(np.int64)
    where = np.zeros(len(starts) + _PAD * docs, np.int32)
    where[np.arange(len(starts)) + _PAD * np.repeat(np.arange(docs), np.diff(first))] = inv + 1
    return feats, where, first + _PAD * np.arange(docs + 1)


def sample_types(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_types`` of a whole sample, made by slices; a word may have a row for each slice it is in."""
    feats, where, first = [np.zeros((1, 1 + len(PREFIXES)), np.int32)], [], [np.zeros(1, np.int64)]
    rows, words = 1, 0
    for d, o in sliced(data, offs):
        f, w, a = word_types(d, o)
        feats.append(f[1:])
        where.append(np.where(w > 0, w + np.int32(rows - 1), 0).astype(np.int32))
        first.append(a[1:] + words)
        rows, words = rows + len(f) - 1, words + len(w)
    return np.concatenate(feats), np.concatenate(where or [np.zeros(0, np.int32)]), np.concatenate(first)


@dataclass
class Cnn:
    emb: np.ndarray  # BUCKETS x DIM; row 0 (padding) is 0
    conv: list[np.ndarray]  # of each width: width x DIM x FILTERS
    bias: np.ndarray  # a filter's bias
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, feats: np.ndarray) -> np.ndarray:
        v = self.emb[feats[:, 0]].copy()
        for k in range(1, feats.shape[1]):
            v += self.emb[feats[:, k]]
        return v

    def pools(self, vec: np.ndarray, where: np.ndarray, first: np.ndarray, args: bool = False):
        """Max of every filter in every document, before the rectifier; with args its positions too."""
        n, docs = int(first[-1]), len(first) - 1
        out, at = np.empty((docs, len(WIDTHS) * FILTERS), np.float32), None
        if args:
            at = np.empty(out.shape, np.int64)
        for k, w in enumerate(WIDTHS):
            z = None
            for j in range(w):
                t = (vec @ self.conv[k][j])[where]
                if z is None:
                    z = t
                else:
                    z[: n - j] += t[j:]
            z[np.concatenate([first[1:] - 1 - i for i in range(_PAD)])] = 0  # padding starts no window
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(z, first[:-1], axis=0)
            out[:, cols] = top
            if args:
                hit = z == np.repeat(top, np.diff(first), axis=0)
                pos = np.where(hit, np.arange(n)[:, None], n)
                at[:, cols] = np.minimum.reduceat(pos, first[:-1], axis=0)
        return out, at

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        feats, where, first = word_types(data, offs)
        pool, _ = self.pools(self.vectors(feats), where, first)
        return np.maximum(pool + self.bias, 0).astype(np.float64) @ self.out[:-1] + self.out[-1] - self.shift


def fit(data: np.ndarray, offs: np.ndarray, label: np.ndarray, lang: list[str | None] | None = None, epochs: int = 6, batch: int = 64, seed: int = 1) -> Cnn:
    """Train on whole texts. One dimension of the embeddings starts from smoothed log odds."""
    rng = np.random.default_rng(seed)
    docs = len(label)
    kinds = len(WIDTHS) * FILTERS
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Cnn(emb, conv, np.zeros(kinds, np.float32), np.concatenate([np.full(kinds, 0.3), [-1.0]]))
    emb[0] = 0
    if not docs or len(set(label.tolist())) < 2:
        rate = (label.sum() + 0.5) / (docs + 1)
        net.out[:] = 0
        net.out[-1] = np.log(rate / (1 - rate))
        return net
    y = label.astype(np.float64)
    feats, where, first = sample_types(data, offs)
    # log odds of each bucket, counted once in a document
    width = feats.shape[1]
    counts = np.zeros((2, BUCKETS))
    for d in range(docs):
        types = np.unique(where[first[d] : first[d + 1]])
        counts[label[d], np.unique(feats[types])] += 1
    rate = y.mean()
    odds = np.log((counts[1] + 4 * rate) / (counts[0] + 4 * (1 - rate))) - np.log(rate / (1 - rate))
    emb[1:, 0] = odds[1:] / width
    for k, w in enumerate(WIDTHS):
        conv[k][:, 0, : FILTERS // 2] += 1.0 / w
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    acc = [np.full_like(emb, 1e-3), [np.full_like(c, 1e-3) for c in conv], np.full_like(net.bias, 1e-3), np.full_like(net.out, 1e-3)]
    for epoch in range(epochs):
        lr = 0.05 / (1 + 0.5 * epoch)
        for part in np.array_split(rng.permutation(docs), max(1, docs // batch)):
            lens = np.diff(first)[part]
            begin = np.concatenate([[0], np.cumsum(lens)])
            pos = np.repeat(first[part] - begin[:-1], lens) + np.arange(begin[-1])
            types, local = np.unique(where[pos], return_inverse=True)
            vec = net.vectors(feats[types])
            drop = rng.random(len(types)) < 0.1  # whole words are dropped at times
            vec[drop] = 0
            pool, at = net.pools(vec, local, begin, True)
            act = np.maximum(pool + net.bias, 0)
            g = (sigmoid(act @ net.out[:-1] + net.out[-1]) - y[part]) * weight[part] / len(part)
            grad_out = np.concatenate([act.T @ g, [g.sum()]]) + 1e-4 * net.out
            back = (np.outer(g, net.out[:-1]) * (pool + net.bias > 0)).astype(np.float32)
            rows, grads = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    t = local[np.minimum(at[:, cols] + j, begin[-1] - 1)]
                    v = vec[t]  # docs x FILTERS x DIM
                    grad = np.einsum("dfe,df->ef", v, back[:, cols]) + 1e-5 * conv[k][j]
                    acc[1][k][j] += grad**2
                    step = np.einsum("ef,df->dfe", conv[k][j], back[:, cols])
                    rows.append(t.ravel())
                    grads.append(step.reshape(-1, DIM))
                    conv[k][j] -= lr * grad / np.sqrt(acc[1][k][j])
            t, gr = np.concatenate(rows), np.concatenate(grads)
            gr[drop[t]] = 0
            ids = feats[types][t]
            u, inv = np.unique(ids.ravel(), return_inverse=True)
            total = np.zeros((len(u), DIM), np.float32)
            np.add.at(total, inv, np.repeat(gr, width, axis=0))
            total[u == 0] = 0
            acc[0][u] += total**2
            emb[u] -= lr * total / np.sqrt(acc[0][u])
            grad_b = back.sum(axis=0)
            acc[2] += grad_b**2
            net.bias -= lr * grad_b / np.sqrt(acc[2])
            acc[3] += grad_out**2
            net.out -= lr * grad_out / np.sqrt(acc[3])
    raw = np.concatenate([net.logits(d, o) for d, o in sliced(data, offs)])
    names = np.array(lang if lang is not None else [None] * docs, object)
    calibrate(net, raw, names, label, np.ones(docs, np.int64))
    return net


def calibrate(net: Cnn, raw: np.ndarray, lang: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> None:
    """Set shift and thresholds by scores without a shift; ``hits`` of the ``rows`` of a score are toxic."""
    net.shift = best_f1(raw, hits, rows)
    net.thresholds = {}
    for name in sorted({x for x in lang if x is not None}):
        own = lang == name
        if hits[own].sum() >= 10 and (rows - hits)[own].sum() >= 10:
            net.thresholds[name] = float(sigmoid(np.array([best_f1(raw[own] - net.shift, hits[own], rows[own])]))[0])


def calibrate_labelled(net: Cnn, docs: DataFrame, labels: DataFrame) -> None:
    """``calibrate`` by all labelled rows that are not held out.

    Texts are scored where they are; only ids, languages and steps meet the labels. The driver gets
    counts: a row for each language and step that occurs.
    """
    net.shift = 0.0
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))

    def run(it):
        for ids, data, offs, at, batch in batches(it, PIECE_BYTES):
            step = np.floor(np.clip(net.logits(data, offs), -30, 30) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(at, len(ids)), pa.array(step)], names=["__id", "lang", "step"])

    steps = rows.mapInArrow(run, "__id long, lang string, step int").join(known_labels(labels, "toxic"), "__id")
    t = steps.groupBy("lang", "step").agg(F.sum("__label").alias("hits"), F.count(F.lit(1)).alias("rows")).toArrow().sort_by([("step", "ascending"), ("lang", "ascending")])
    if not t.num_rows:
        return
    names = np.array(t.column("lang").to_pylist(), object)
    raw, hits, n = ((t.column(c).to_numpy().astype(np.int64)) for c in ("step", "hits", "rows"))
    # an empty step below a language's lowest: a threshold is always between steps
    ends = sorted(set(names.tolist()), key=str)
    low = np.full(len(ends), raw.min() - 1)
    raw, names = np.concatenate([raw, low]), np.concatenate([names, np.array(ends, object)])
    hits, n = (np.concatenate([x, np.zeros(len(ends), np.int64)]) for x in (hits, n))
    calibrate(net, (raw + 0.5) / STEPS, names, hits, n)


def fit_table(t: pa.Table) -> tuple[Cnn, bool]:
    """(the network of a sample, whether both classes are in it)"""
    data, offs = table_buffers(t)
    label = t.column("label").to_numpy().astype(np.int64)
    return fit(data, offs, label, t.column("lang").to_pylist() if "lang" in t.column_names else None), bool(0 < label.sum() < len(label))


def fit_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Cnn:
    """Fit on a bounded sample of labelled rows (``labelled_sample``), in a task; thresholds are those of all
    labelled rows that are not held out."""
    sample = labelled_sample(docs, labels, "toxic", per_class, ("lang",) if "lang" in docs.columns else ())
    net, both = fit_on_executor(sample, fit_table)
    if both:
        calibrate_labelled(net, docs, labels)
    return net


def score(docs: DataFrame, net: Cnn, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, score, and whether the score reaches the threshold of the document's language."""
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))

    def run(it):
        for ids, data, offs, at, batch in batches(it, PIECE_BYTES):
            s = sigmoid(net.logits(data, offs))
            langs = batch.column(2).slice(at, len(ids)).to_pylist()
            limit = np.array([net.thresholds.get(x, 0.5) for x in langs])
            yield pa.RecordBatch.from_arrays([ids, pa.array(s), pa.array(s >= limit)], names=["doc_id", "score", "flagged"])

    return rows.mapInArrow(run, "doc_id long, score double, flagged boolean")
