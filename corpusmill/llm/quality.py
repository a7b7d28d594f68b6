"""Quality classifier: a factorisation machine in numpy.

Features of a text are its hashed words (each occurrence weighs one over the number of words),
structure statistics, and hashed metadata (the order of magnitude of its length). The machine adds
low-rank products of all pairs of features; the sum-of-squares identity makes a score linear in the
number of words. The score is the probability of label 1.

Defined results: a null or empty text has no words, and its score comes from the structure statistics of an
empty text; every row has its score, also rows that repeat and rows without an id (which are never learnt
from); an empty table gives an empty table, and without labels of both classes every score is the labels'
smoothed share; further columns, whatever their names, do not matter; a long text is a slice of work of its own, read
whole. Language, source, ids and labels are no features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batches, span_hashes, texts, word_spans
from .labelled import PER_CLASS, class_counts, fit_on_executor, labelled_sample, sigmoid, sliced, table_buffers

BUCKETS = 1 << 15
RANK = 8
#: Hashed metadata: one bucket for each power of two of the length.
META = 40

_UPPER, _ALPHA, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC2, 256)]] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASSES = (_UPPER, _ALPHA, _DIGIT, _MARK)
_POINT = np.zeros(256, bool)
_POINT[[33, 35, 36, 37, 38, 42, 124]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each document, structure statistics, metadata bucket)."""
    starts, ends, first = word_spans(data, offs)
    h = span_hashes(data, starts, ends)
    bucket = (h % U(BUCKETS)).astype(np.int32)
    docs = len(offs) - 1
    size, words = np.diff(offs), np.diff(first)

    def per_doc(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[at[1:]] - sums[at[:-1]]

    upper, alpha, digit, mark = (per_doc(m[data], offs) for m in _CLASSES)
    point = per_doc(_POINT[data], offs)
    line = per_doc(data == 10, offs)
    doc = np.repeat(np.arange(docs), words)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = per_doc(same, first)
    distinct = np.zeros(docs, np.int64)
    if len(h):
        key = np.sort(mix_doc(h, doc))
        pairs = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key[pairs] >> U(40)).astype(np.int64), minlength=docs)[:docs]
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd_end = per_doc(_POINT[last], first)
    long_words = per_doc((ends - starts) > 20, first)
    one = per_doc((ends - starts) == 1, first)
    stats = np.stack(
        [
            np.sqrt(upper / n),
            alpha / n,
            np.sqrt(digit / n),
            np.sqrt(mark / n),
            np.sqrt(point / n),
            np.sqrt(again / w),
            distinct / w,
            np.sqrt(odd_end / w),
            np.sqrt(long_words / w),
            np.sqrt(one / w),
            np.log1p(words),
            np.log1p(size / w),
            np.log1p(line / w * 100),
            (words == 0).astype(float),
        ],
        axis=1,
    )
    return bucket, first, stats, np.minimum(np.log2(size + 1).astype(np.int64), META - 1)


def sample_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of a whole sample, made by slices."""
    parts = [features(d, o) for d, o in sliced(data, offs)] or [features(data, offs)]
    words = np.cumsum([0] + [len(p[0]) for p in parts])
    first = np.concatenate([[0], *(p[1][1:] + w for p, w in zip(parts, words, strict=False))])
    return np.concatenate([p[0] for p in parts]), first, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def mix_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Document in the upper bits, 40 bits of the hash below."""
    return (doc.astype(U) << U(40)) | (h >> U(24))


N_STATS = 14


@dataclass
class Machine:
    bias: float
    word: np.ndarray  # BUCKETS x (1 + RANK): linear weight, then factors
    stat: np.ndarray  # N_STATS x (1 + RANK)
    meta: np.ndarray  # META x (1 + RANK)
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        bucket, first, stats, meta = features(data, offs)
        return self.forward(bucket, first, self.standard(stats), meta)[0]

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6)

    def forward(self, bucket, first, x, meta):
        n = np.maximum(np.diff(first), 1)[:, None]
        rows = self.word[bucket]
        full = np.diff(first) > 0
        s = np.zeros((len(n), 1 + RANK))
        q = np.zeros((len(n), RANK))
        if len(bucket):
            at = first[:-1][full]
            s[full] = np.add.reduceat(rows, at, axis=0)
            rows = rows[:, 1:]
            q[full] = np.add.reduceat(rows * rows, at, axis=0)
        s = s / n + x @ self.stat + self.meta[meta]
        q = q / n**2 + (x * x) @ (self.stat[:, 1:] ** 2) + self.meta[meta][:, 1:] ** 2
        return self.bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - q.sum(axis=1)), s


def fit(data: np.ndarray, offs: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, seed: int = 1) -> Machine:
    rng = np.random.default_rng(seed)
    docs = len(label)

    def start(n):
        return np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.02, (n, RANK))], axis=1)

    bucket, first, stats, meta = sample_features(data, offs)
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-3) if docs else (np.zeros(N_STATS), np.ones(N_STATS))
    rate = (label.sum() + 0.5) / (docs + 1)
    m = Machine(float(np.log(rate / (1 - rate))), start(BUCKETS).astype(np.float32), start(N_STATS), start(META), mean, scale)
    if not docs or len(set(label.tolist())) < 2:
        m.word[:], m.stat[:], m.meta[:] = 0, 0, 0
        return m
    y = label.astype(np.float64)
    x = m.standard(stats)
    acc = [np.full_like(a, 1e-2) for a in (m.word, m.stat, m.meta)]
    acc_b = 1e-2
    for epoch in range(epochs):
        lr = 0.1 / (1 + 0.3 * epoch)
        for part in np.array_split(rng.permutation(docs), max(1, docs // batch)):
            lens = np.diff(first)[part]
            begin = np.concatenate([[0], np.cumsum(lens)])
            pos = np.repeat(first[part] - begin[:-1], lens) + np.arange(begin[-1])
            b, xp, mp = bucket[pos], x[part], meta[part]
            z, s = m.forward(b, begin, xp, mp)
            g = (sigmoid(z) - y[part]) / len(part)
            share = g / np.maximum(lens, 1)
            # words: d/dv = x * (sum - v * x); gathered by bucket and document
            doc = np.repeat(np.arange(len(part)), lens)
            pair, count = np.unique(doc * BUCKETS + b, return_counts=True)
            d, u = pair // BUCKETS, pair % BUCKETS
            c = (share[d] * count)[:, None]
            grad = np.empty((len(pair), 1 + RANK))
            grad[:, :1] = c
            grad[:, 1:] = c * (s[d][:, 1:] - m.word[u][:, 1:] / np.maximum(lens, 1)[d][:, None])
            ids, inv = np.unique(u, return_inverse=True)
            total = np.stack([np.bincount(inv, weights=grad[:, k], minlength=len(ids)) for k in range(1 + RANK)], axis=1)
            total += 1e-5 * m.word[ids]
            acc[0][ids] += total**2
            m.word[ids] -= lr * total / np.sqrt(acc[0][ids])
            gs = np.empty_like(m.stat)
            gs[:, 0] = xp.T @ g
            gs[:, 1:] = xp.T @ (g[:, None] * s[:, 1:]) - m.stat[:, 1:] * ((xp * xp).T @ g)[:, None]
            gs += 1e-4 * m.stat
            acc[1] += gs**2
            m.stat -= lr * gs / np.sqrt(acc[1])
            gm = np.zeros_like(m.meta)
            np.add.at(gm[:, 0], mp, g)
            np.add.at(gm[:, 1:], mp, g[:, None] * (s[:, 1:] - m.meta[mp][:, 1:]))
            gm += 1e-4 * m.meta
            acc[2] += gm**2
            m.meta -= lr * gm / np.sqrt(acc[2])
            acc_b += g.sum() ** 2
            m.bias -= lr * g.sum() / np.sqrt(acc_b)
    return m


def fit_table(t: pa.Table) -> tuple[Machine, int, int]:
    """(the machine of a sample, its rows of label 0 and of label 1)"""
    data, offs = table_buffers(t)
    label = t.column("label").to_numpy().astype(np.int64)
    return fit(data, offs, label), int((label == 0).sum()), int(label.sum())


def fit_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Fit on a bounded sample of labelled rows (``labelled_sample``), in a task."""
    m, zeros, ones = fit_on_executor(labelled_sample(docs, labels, "quality", per_class), fit_table)
    # the sample is even between the classes: back to the odds of all labelled rows
    n = class_counts(labels, "quality")
    if zeros and ones:
        m.bias += float(np.log(n[1] / n[0]) - np.log(ones / zeros))
    return m


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""

    def run(it):
        for ids, data, offs, _, _ in batches(it):
            yield pa.RecordBatch.from_arrays([ids, pa.array(sigmoid(machine.logits(data, offs)))], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, machine: Machine, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with all their columns."""
    at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def run(it):
        for batch in it:
            row = batch.column(0)
            text, keep = row.field(at), [np.zeros(0, bool)]
            ids = pa.array(np.zeros(len(row), np.int64))
            for _, data, offs, _, _ in batches([pa.RecordBatch.from_arrays([ids, text], names=["doc_id", "text"])]):
                keep.append(sigmoid(machine.logits(data, offs)) >= least)
            row = row.filter(pa.array(np.concatenate(keep)))
            yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])

    return rows.mapInArrow(run, docs.schema)
