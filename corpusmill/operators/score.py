"""Scorers: log-probabilities of tokens. N-gram models are joins; others run on Arrow batches of windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from .lookup import sized
from .model import input_arrays


class Causal(Protocol):
    """What a language model offers: scores of windows, and greedy continuation."""

    def score(self, windows: DataFrame) -> DataFrame:
        """windows and ``logprobs``: one number per token but the first."""

    def generate(self, prompt: list[int], steps: int) -> list[int]:
        """``steps`` tokens after the prompt, each the likeliest, the smallest id of ties."""


def exploded(tokens: DataFrame) -> DataFrame:
    """(doc, pos, token, prev, length) of (doc, tokens)."""
    # each token travels with its predecessor, so no row carries the array
    kind = tokens.schema["tokens"].dataType.elementType
    before = F.concat(F.array(F.lit(None).cast(kind)), F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))))
    t = tokens.where(F.size("tokens") > 0).select("doc", F.size("tokens").alias("length"), F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), before.alias("prev"))).alias("pos", "x"))
    return t.select("doc", "pos", "x.token", "x.prev", "length")


def unigram(tokens: DataFrame) -> DataFrame:
    """(token, logprob) from the corpus itself; the total is the sum of the small table of counts."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token", F.log(F.col("cnt") / F.col("total")).cast("float").alias("logprob"))


def pair_counts(each: DataFrame) -> DataFrame:
    """(prev, token, n): how often a token follows another."""
    return each.where(F.col("prev").isNotNull()).groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n"))


def bigram(pairs: DataFrame, vocabulary: int, k: float = 0.1) -> DataFrame:
    """(prev, token, logprob) of the pairs that occur: ln((c(prev, token) + k) / (c(prev) + k V))."""
    first = pairs.groupBy("prev").agg(F.sum("n").alias("m"))
    return pairs.join(first, "prev").select("prev", "token", F.log((F.col("n") + k) / (F.col("m") + k * vocabulary)).cast("float").alias("logprob"))


class Bigram:
    """A bigram model as a scorer of whole windows and a greedy generator."""

    def __init__(self, table: DataFrame) -> None:
        self.table, self.best = table, None

    def score(self, windows: DataFrame) -> DataFrame:
        pair = F.transform(F.sequence(F.lit(2), F.greatest(F.size("tokens"), F.lit(2))), lambda i: F.struct((i - 1).cast("int").alias("i"), F.get("tokens", i - 2).alias("prev"), F.get("tokens", i - 1).alias("token")))
        w = windows.where(F.size("tokens") > 1).select("doc", "position", F.explode(pair).alias("x")).select("doc", "position", "x.*")
        w = w.join(sized(self.table), ["prev", "token"], "left")
        lists = w.groupBy("doc", "position").agg(F.array_sort(F.collect_list(F.struct("i", "logprob"))).alias("x"))
        return windows.join(lists, ["doc", "position"], "left").withColumn("logprobs", F.transform("x", lambda v: v["logprob"])).drop("x")

    def generate(self, prompt: list[int], steps: int) -> list[int]:
        if not prompt:
            raise ValueError("the prompt is empty")
        if self.best is None:
            # one row for each token of the vocabulary
            best = self.table.groupBy("prev").agg(F.min(F.struct((-F.col("logprob")).alias("cost"), "token")).alias("x"))
            self.best = {r["prev"]: r["token"] for r in best.select("prev", "x.token").toLocalIterator()}
        out = list(prompt)
        while len(out) < len(prompt) + steps and out[-1] in self.best:
            out.append(self.best[out[-1]])
        return out[len(prompt) :]


class ArrowScorer:
    """Any function of a (windows x length) array to (windows x length - 1) log-probabilities.

    Windows of a call have one length, ``batch`` of them at most; the function is made once per task.
    """

    def __init__(self, make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 32) -> None:
        self.make, self.batch = make, batch

    def score(self, windows: DataFrame) -> DataFrame:
        make, most = self.make, self.batch

        def run(it):
            model = make()
            for b in it:
                rows = [np.array(x, np.int64) for x in b.column("tokens").to_pylist()]
                out: list = [None] * len(rows)
                for n in sorted({len(r) for r in rows}):
                    same = [k for k, r in enumerate(rows) if len(r) == n]
                    for i in range(0, len(same), most):
                        part = same[i : i + most]
                        got = model(np.stack([rows[k] for k in part])) if n > 1 else np.zeros((len(part), 0))
                        for k, g in zip(part, got, strict=True):
                            out[k] = [float(x) for x in g]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "logprobs"])

        schema = T.StructType([*windows.schema.fields, T.StructField("logprobs", T.ArrayType(T.FloatType()))])
        return windows.mapInArrow(run, schema)


#: Tokens of a vocabulary whose pairs fit one table in memory.
DENSE = 1 << 11


def dense_table(table: DataFrame, vocabulary: int) -> np.ndarray:
    """A bigram model (prev, token, logprob) over few tokens as an array; pairs that do not occur are NaN."""
    if vocabulary > DENSE:
        raise ValueError("too many tokens for a dense table; join the model instead")
    cells = table.select("prev", "token", "logprob").toArrow()  # vocabulary * vocabulary rows at most
    dense = np.full((vocabulary, vocabulary), np.nan, np.float32)
    dense[cells["prev"].to_numpy(), cells["token"].to_numpy()] = cells["logprob"].to_numpy()
    return dense


def dense_bigram(table: DataFrame, vocabulary: int, batch: int = 32) -> ArrowScorer:
    """A bigram model (prev, token, logprob) over few tokens (at most ``DENSE``) as an array that each executor gets once,
    and a scorer of Arrow batches over it. Pairs that do not occur are NaN."""
    held = table.sparkSession.sparkContext.broadcast(dense_table(table, vocabulary))
    return ArrowScorer(lambda: lambda tokens: held.value[tokens[:, :-1], tokens[:, 1:]], batch)


def onnx_scorer(path: str, batch: int = 32) -> ArrowScorer:
    """A scorer over an ONNX model with inputs input_ids (and position_ids, attention_mask where it has
    them) and output logits or log-probabilities; needs onnxruntime and a model file on the executors."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        names = {x.name for x in session.get_inputs()}

        def run(tokens: np.ndarray) -> np.ndarray:
            out = session.run(None, {k: v for k, v in input_arrays(tokens).items() if k in names})[0]
            if out.ndim == 2:
                return out
            top = out.max(axis=-1, keepdims=True)
            logp = out - top - np.log(np.exp(out - top).sum(axis=-1, keepdims=True))
            return np.take_along_axis(logp[:, :-1], tokens[:, 1:, None], axis=-1)[..., 0]

        return run

    return ArrowScorer(make, batch)


def aligned(scored: DataFrame) -> DataFrame:
    """(doc, position, i, token, logprob): what counts of each scored window, by seen and pads."""
    first = F.col("pad_left") + F.col("seen")
    n = F.size("tokens") - F.col("pad_right") - first
    s = scored.where(n > 0).withColumn("__z", F.arrays_zip(F.slice("tokens", first + 1, n).alias("token"), F.slice("logprobs", first, n).alias("logprob")))
    s = s.select("doc", "position", "seen", "start", F.posexplode("__z").alias("i", "z"))
    return s.select("doc", "position", "start", "seen", "i", F.col("z.token").alias("token"), F.col("z.logprob").alias("logprob"))


def evaluate(windows: DataFrame, scorer: Causal, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score windows and hand the aligned rows to ``result``."""
    return result(aligned(scorer.score(windows)))
