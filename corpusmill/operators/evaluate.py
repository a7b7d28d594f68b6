"""Perplexity and the context table, as plans over exploded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .lookup import sized
from .score import bigram, exploded, pair_counts, unigram
from .windows import WindowConfig, scored_positions, times_scored


def perplexity(scored: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(n, ppl): exp of the mean negative log-probability. ``weight``: targets per row where not 1."""
    lp = F.col("logprob").cast("double")
    n = F.count("logprob") if weight is None else F.sum(weight)
    total = F.sum(lp) if weight is None else F.sum(lp * weight)
    agg = [n.cast("long").alias("n"), F.exp(-total / n).alias("ppl")]
    return scored.groupBy(*by).agg(*agg) if by else scored.agg(*agg)


def perplexity_matched(scored: DataFrame, window: str = "position") -> DataFrame:
    """(n, ppl) in the common formulation that counts one target less for each window but the first."""
    lp = F.col("logprob").cast("double")
    w = scored.groupBy(window).agg(F.sum(lp).alias("lp"), F.count(F.lit(1)).alias("m"))
    n = F.when(F.col(window) == 0, F.col("m")).otherwise(F.col("m") - 1)
    return w.agg(F.sum(n).alias("n"), F.exp(-F.sum(F.col("lp") / F.col("m") * n) / F.sum(n)).alias("ppl"))


def unigram_scores(each: DataFrame, c: WindowConfig, model: DataFrame | None = None) -> DataFrame:
    """Scored rows of (doc, pos, token, length) under the corpus's own unigram model.

    The log-probability belongs to the token, so the model is joined before tokens meet windows; a model of
    checked size is broadcast, and tokens are not shuffled. ``model``: its table, where tokens can be counted without their places.
    """
    return scored_positions(each.join(sized(unigram(each) if model is None else model), "token"), c)


def unigram_perplexity(each: DataFrame, c: WindowConfig, by: list[str] | None = None) -> DataFrame:
    """(n, ppl) of all scored tokens under the corpus's own unigram model, without a row for each of them.

    A token's log-probability is the same wherever it is scored: one aggregation, combined before its
    shuffle, gives each token's count and how often it is scored, and the rest works on distinct tokens.
    """
    by = by or []
    t = each.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("cnt"), F.sum(times_scored(c)).alias("times"))
    if by:
        t = t.join(t.groupBy("token").agg(F.sum("cnt").alias("all")), "token")
    else:
        t = t.withColumn("all", F.col("cnt"))
    total = t.agg(F.sum("cnt").alias("total"))
    t = t.crossJoin(F.broadcast(total)).withColumn("logprob", F.log(F.col("all") / F.col("total")).cast("float")).where("times > 0")
    return perplexity(t, by, F.col("times"))


def bigram_scores(each: DataFrame, c: WindowConfig, vocabulary: int, k: float = 0.1, counts: DataFrame | None = None) -> DataFrame:
    """Scored rows of (doc, pos, token, prev, length); a scored token always has its predecessor in the
    window. ``counts``: those of ``pair_counts``, where they are known."""
    counts = staged(pair_counts(each), "pairs") if counts is None else counts
    return scored_positions(each.join(sized(bigram(counts, vocabulary, k)), ["prev", "token"]), c)


def context(tokens: DataFrame, c: WindowConfig, vocabulary: int, k: float = 0.1, counts: DataFrame | None = None) -> DataFrame:
    """(uid, token, logprob, pos): a row for each scored token, at its position in the document."""
    s = bigram_scores(exploded(tokens), c, vocabulary, k, counts)
    return s.select(F.col("doc").cast("int").alias("uid"), F.col("token").cast("int").alias("token"), "logprob", F.col("pos").cast("int").alias("pos"))
