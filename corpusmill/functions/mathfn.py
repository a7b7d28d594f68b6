"""Array mathematics of the scorer: softmax, log-softmax, top k, gathering, RMSE. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def softmax(x: Column) -> Column:
    """Shifted by the largest value; an empty array stays empty."""
    e = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x)))
    return F.transform(e, lambda v: v / _sum(e))


def log_softmax(x: Column) -> Column:
    m = F.array_max(x).cast("double")
    z = F.log(_sum(F.transform(x, lambda v: F.exp(v.cast("double") - m)))) + m
    return F.transform(x, lambda v: v.cast("double") - z)


def top_k(x: Column, k: int) -> Column:
    """Indices (from 0) of the k largest values, ties by index; all of them when there are fewer."""
    pairs = F.transform(x, lambda v, i: F.struct((-v.cast("double")).alias("n"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, max(k, 1)), lambda p: p["i"]) if k > 0 else F.array().cast("array<int>")


def sample_greedy(x: Column) -> Column:
    """The index of the largest value, the smallest of ties."""
    return F.get(top_k(x, 1), F.lit(0))


def gather_next(log_probs: Column, tokens: Column) -> Column:
    """Of rows of log-probabilities after each token, those of the token that follows."""
    return F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.get(F.get(log_probs, i), t))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference; arrays of unequal length are an error."""
    same = F.size(a) == F.size(b)
    d = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(same, _sum(d) / F.size(a)).otherwise(F.raise_error(F.lit("lengths differ")).cast("double"))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mse(a, b))
