"""The tokenisation-bias experiment: merge rules, rewriting of scored tokens, grouped statistics, and the
regression discontinuity at the cutoff. ``window=None`` is unbounded everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .lookup import sized
from .quantiles import LIGHT, quantiles

# ---------------------------------------------------------------- rules


def surrogate_merges(counts: DataFrame, k: int, vocabulary: int) -> DataFrame:
    """(rank, a, b, c): the ``k`` most frequent pairs of counts (prev, token, n), as one round of merging."""
    top = counts.orderBy(F.desc("n"), "prev", "token").limit(k)
    w = Window.orderBy(F.desc("n"), "prev", "token")  # over k rows
    return top.select((F.row_number().over(w) - 1).cast("int").alias("rank"), F.col("prev").cast("int").alias("a"), F.col("token").cast("int").alias("b")).withColumn("c", (F.col("rank") + vocabulary).cast("int"))


def rules(merges: DataFrame, vocab: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """(rank, a, b, c, valid) of merges (rank, left, right): ids of the parts and of the product."""
    v = sized(vocab.select("id", "token"))
    m = merges.withColumn("made", F.concat("left", "right"))
    for column, out in (("left", "a"), ("right", "b"), ("made", "c")):
        m = m.join(v.select(F.col("token").alias(column), F.col("id").alias(out)), column, "left")
    m = m.withColumn("c", F.when(F.col("a").isNull() | F.col("b").isNull() | F.col("c").isNull(), F.raise_error(F.lit("a part of a merge is no token")).cast("long")).otherwise(F.col("c")))
    if reachable is None:
        return m.select("rank", "a", "b", "c", F.lit(True).alias("valid"))
    r = reachable.select(F.col("token").alias("made"), F.lit(True).alias("valid"))
    return m.join(r, "made", "left").select("rank", "a", "b", "c", F.coalesce("valid", F.lit(False)).alias("valid"))


def in_window(r: DataFrame, cutoff: int, window: int | None) -> DataFrame:
    return r if window is None else r.where((F.col("c") >= cutoff - window) & (F.col("c") < cutoff + window))


def not_component(r: DataFrame, cutoff: int) -> DataFrame:
    """Without in-vocabulary rules whose product is a part of another rule."""
    parts = r.select(F.col("a").alias("p")).union(r.select("b")).distinct()
    inside, outside = r.where(F.col("c") < cutoff), r.where(F.col("c") >= cutoff)
    return inside.join(parts, F.col("c") == F.col("p"), "left_anti").union(outside)


def out_of_vocabulary(r: DataFrame, cutoff: int) -> DataFrame:
    return r.where(F.col("c") >= cutoff)


def extract(r: DataFrame, cutoff: int, window: int | None, clamp: bool = True) -> tuple[DataFrame, DataFrame]:
    """(final rules, counts of the stages: windowed, filtered, kept)."""
    valid = r.where("valid") if "valid" in r.columns else r
    one = in_window(valid, cutoff, window) if clamp else valid
    two = not_component(one, cutoff)
    three = out_of_vocabulary(two, cutoff)
    counts = None
    for name, stage in (("windowed", one), ("filtered", two), ("kept", three)):
        c = stage.agg(F.count(F.lit(1)).alias(name))
        counts = c if counts is None else counts.crossJoin(c)
    return three, counts


# ---------------------------------------------------------------- rewriting


#: Positions of a document that one task takes at a time.
STRETCH = 1 << 20


def pairs(context: DataFrame, longest: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """Each row with its neighbours' tokens, by row order within a document.

    Documents are cut into stretches of positions, so a long one is many tasks. Within a stretch the neighbours are a
    window; at its edges they are the last and first token of the stretches beside it, of which there is one row each. Rows
    are shuffled once: the edges are taken from the same exchange. Where the caller knows that no position is above
    ``longest`` and that is within one stretch, there are no edges to look for.
    """
    if longest is not None and longest < stretch:
        of = Window.partitionBy("uid").orderBy("pos")
        return context.select("uid", "pos", "token", "logprob", F.lead("token", 1).over(of).alias("next_tok"), F.lag("token", 1).over(of).alias("prev_tok"))
    c = context.select("uid", "pos", "token", "logprob", F.floor(F.col("pos") / F.lit(stretch)).alias("part")).repartition("uid", "part")
    row = F.struct("pos", "token", "logprob")  # all columns, so that both readers of the exchange ask for the same
    edges = c.groupBy("uid", "part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    of = Window.partitionBy("uid").orderBy("part")
    edges = edges.select("uid", "part", F.lead("first.token").over(of).alias("after"), F.lag("last.token").over(of).alias("before"))
    w = Window.partitionBy("uid", "part").orderBy("pos")
    c = c.select("*", F.lead("token", 1).over(w).alias("next_tok"), F.lag("token", 1).over(w).alias("prev_tok"))
    e = edges.where("after IS NOT NULL OR before IS NOT NULL").toDF("of", "p", "after", "before")
    j = c.join(e, c["uid"].eqNullSafe(e["of"]) & c["part"].eqNullSafe(e["p"]), "left")
    return j.select("uid", "pos", "token", "logprob", F.coalesce("next_tok", "after").alias("next_tok"), F.coalesce("prev_tok", "before").alias("prev_tok"))


def matched(p: DataFrame, r: DataFrame) -> DataFrame:
    """The rule that merges a token with its successor, and the one with its predecessor.

    Rules are as many as the merges of a vocabulary within the window; of a checked size they are
    broadcast, and tokens stay where their document is.
    """
    r = sized(r)
    one = r.select(F.col("a").alias("token"), F.col("b").alias("next_tok"), F.col("c").alias("merged_as_first"))
    two = r.select(F.col("a").alias("prev_tok"), F.col("b").alias("token"), F.col("c").alias("merged_as_second"))
    m = p.join(one, ["token", "next_tok"], "left").join(two, ["prev_tok", "token"], "left")
    return m.select("uid", "pos", "token", "logprob", "next_tok", "prev_tok", "merged_as_first", "merged_as_second")


def summed(m: DataFrame, cutoff: int, window: int | None) -> DataFrame:
    """Log-probabilities by rewritten token: the first match takes precedence, and a second part moves to
    the place of the first."""
    tok = F.coalesce("merged_as_first", "merged_as_second", "token")
    pos = F.when(F.col("merged_as_first").isNotNull(), F.col("pos")).when(F.col("merged_as_second").isNotNull(), F.col("pos") - 1).otherwise(F.col("pos"))
    p = m.select("uid", tok.alias("tok"), pos.alias("pos"), F.col("logprob").cast("double").alias("lp"))
    if window is not None:
        p = p.where((F.col("tok") >= cutoff - window) & (F.col("tok") < cutoff + window))
    return p.groupBy("uid", "tok", "pos").agg(F.sum("lp").alias("token_logprob"))


def results(s: DataFrame, cutoff: int, light: int = LIGHT) -> DataFrame:
    """Exact quartiles, mean, deviation and number of each token. ``treat``: below the cutoff. Equal sums of a token are counted
    before they are shuffled."""
    return counted_results(s.groupBy("tok", "token_logprob").agg(F.count(F.lit(1)).alias("n")), cutoff, light)


def counted_results(sums: DataFrame, cutoff: int, light: int = LIGHT) -> DataFrame:
    """``results`` of counted sums (tok, token_logprob, n). They are written once; tokens of more than ``light`` different sums
    get their quartiles by ranges."""
    t = staged(sums.select("tok", "token_logprob", "n"), "sums")
    ps = [0.25, 0.5, 0.75]
    told = t.where("token_logprob IS NOT NULL").groupBy("tok").agg(F.sum(F.col("token_logprob") * F.col("n")).alias("s"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("different"))
    all_ = t.groupBy("tok").agg(F.sum("n").alias("num"))
    stats = staged(all_.join(told.withColumnRenamed("tok", "of"), F.col("tok").eqNullSafe(F.col("of")), "left").select("tok", "num", "m", "different", (F.col("s") / F.col("m")).alias("mean")), "stats")
    few = sized(stats.select(F.col("tok").alias("of"), F.col("mean").alias("center")))
    off = F.col("token_logprob") - F.col("center")
    spread = t.join(few, F.col("tok").eqNullSafe(F.col("of"))).groupBy("of").agg(F.sum(off * off * F.col("n")).alias("squares"))
    if stats.where(F.col("different") > light).head(1):
        q = quantiles(t, stats.select("tok", F.col("different").alias("num")), "tok", "token_logprob", ps, light, "n")
    else:
        q = t.groupBy("tok").agg(F.percentile("token_logprob", F.array(*map(F.lit, ps)), F.col("n")).alias("q"))
    g = stats.join(spread, F.col("tok").eqNullSafe(F.col("of")), "left").drop("of").join(q.withColumnRenamed("tok", "of"), F.col("tok").eqNullSafe(F.col("of")), "left")
    std = F.when(F.col("m") > 1, F.sqrt(F.col("squares") / (F.col("m") - 1)))
    q = F.col("q")
    return g.select("tok", q[1].alias("median"), q[2].alias("q75"), q[0].alias("q25"), (q[2] - q[0]).alias("iqr"), "mean", std.alias("std"), "num", (F.col("tok") < cutoff).alias("treat"))


def sides(r: DataFrame) -> DataFrame:
    """Tokens and samples on each side of the cutoff."""
    name = F.when(F.col("treat"), "left").otherwise("right")
    return r.groupBy("treat").agg(F.count(F.lit(1)).alias("tokens"), F.sum("num").alias("samples")).select("treat", name.alias("side"), "tokens", "samples").orderBy(F.desc("treat"))


def peek(context: DataFrame, r: DataFrame, cutoff: int, n: int | None = None) -> DataFrame:
    """Pairs that a rule merges, with both log-probabilities; the first ``n`` by (uid, pos)."""
    p = pairs(context).select("uid", "pos", "token", "logprob", "next_tok")
    m = p.join(sized(r.where(F.col("c") >= cutoff)).select(F.col("a").alias("token"), F.col("b").alias("next_tok"), "c"), ["token", "next_tok"])
    m = m.withColumn("after", F.col("pos") + 1)
    second = context.select("uid", F.col("pos").alias("after"), F.col("logprob").alias("logprob_b"))
    out = m.join(second, ["uid", "after"]).select("uid", "pos", F.col("token").alias("tok_a"), F.col("logprob").alias("logprob_a"), F.col("next_tok").alias("tok_b"), "logprob_b", F.col("c").alias("tok_c"))
    return out if n is None else out.orderBy("uid", "pos").limit(n)


def peek_named(p: DataFrame, vocab: DataFrame) -> DataFrame:
    """The rows of ``peek`` with token strings and the sum of both log-probabilities."""
    vocab = sized(vocab.select("id", "token"))
    for k in "abc":
        p = p.join(vocab.select(F.col("id").alias(f"tok_{k}"), F.col("token").alias(f"text_{k}")), f"tok_{k}", "left")
    return p.withColumn("logprob_sum", F.col("logprob_a") + F.col("logprob_b"))


# ---------------------------------------------------------------- discontinuity


def fits(r: DataFrame) -> DataFrame:
    """Least squares of the mean over the token id, on each side."""
    x, y = F.col("tok").cast("double"), F.col("mean")
    return r.groupBy("treat").agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.min("tok").alias("x_min"), F.max("tok").alias("x_max"), F.count(F.lit(1)).alias("points")
    )


def delta(r: DataFrame, cutoff: int) -> DataFrame:
    """Both fits at the cutoff, and right minus left; null where a side has no fit."""
    at = F.col("intercept") + F.col("slope") * F.lit(float(cutoff))
    f = fits(r).agg(F.max(F.when(F.col("treat"), at)).alias("left"), F.max(F.when(~F.col("treat"), at)).alias("right"))
    return f.select("left", "right", (F.col("right") - F.col("left")).alias("diff"))


def lines(r: DataFrame, cutoff: int) -> DataFrame:
    """End points of the drawn fits: left from its first to its last point, right from the cutoff on."""
    f = fits(r)
    begin = F.when(F.col("treat"), F.col("x_min")).otherwise(F.lit(cutoff))
    y = lambda x: F.col("intercept") + F.col("slope") * x
    return f.select("treat", begin.alias("x_from"), y(begin).alias("y_from"), F.col("x_max").alias("x_to"), y(F.col("x_max")).alias("y_to"))


def points(r: DataFrame, low: float = -20, high: float = 0) -> DataFrame:
    """The points to draw; fits use all rows."""
    return r.where(F.col("mean").between(low, high)).select("tok", "mean", "treat")


def delta_text(left: float, right: float) -> str:
    return f"left: {left:.6f}\nright: {right:.6f}\ndiff: {right - left:.6f}\n"
