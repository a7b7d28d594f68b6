"""Mixing sources to target weights with soft membership.

Native: DataFrame functions only. A naive Bayes classifier over hashed words, fitted on all rows whose
domain is known, gives every document posteriors over all domains (soft membership): each class's share of
the words counts as ``EVIDENCE`` words at most, by the smooth factor EVIDENCE / (EVIDENCE + words), as
words of one text do not stand for themselves alone. Distributed projected-gradient least squares
then finds rates r >= ``least`` (0 if not given) for the documents such that the expected tokens of each
domain, sum(r * tokens * posterior), match targets. Each step is one aggregation over the
documents to as many sums as there are domains; the step is taken along the posteriors, scaled by the inverse
of their token-weighted Gram matrix (of documents that are not held at the bound), and rates are projected to
the bound. A step that brings the totals no nearer is halved, then replaced by a plain gradient step of a safe
length, which always does unless the least squares are reached. A document's rate is a function of its posteriors and of the
steps so far (a few numbers each), so a pass carries no per-document state; every ``STORE`` steps rates are written and later steps start from them.

A document is then copied floor(rate) times and once more with the chance of the rest, decided by a
hash of its id. With ``targets`` None, targets are ``flatten`` (token shares to a power below 1) scaled so
that every domain grows by ``GROWTH`` at least: documents are repeated, none is dropped for its domain.

Defined results: a null or wordless text has no tokens, the prior as its posterior and rate 1 (not below
``least``); a null domain is no label; without any labelled row there is one domain and all rates are 1; rows that
repeat an id have each the tokens and rate of their own text; an empty table gives an empty table; a
target for a domain that no row has is an error, and a domain without a target has the target 0. For targets that
no rates can meet the fit ends where a gradient step brings the totals less than ``STILL`` of the rest nearer,
with ``Mix.met`` false (the least squares themselves would put all on a few extreme documents); a fit that
comes to neither end within ``steps`` is an error. Words are split at white space, lower-cased; further columns, whatever
their names, do not matter; a long text is counted by words like others.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

BUCKETS = 4096
#: As many words as a text's words can stand for.
EVIDENCE = 24
#: What every domain grows by, at least, where no targets are given: room for what posteriors share out.
GROWTH = 0.02
#: A step that brings less of the rest than this ends the fit.
STILL = 0.01
#: Steps after which rates are written, so that a pass evaluates no more of them than that.
STORE = 8
#: Up to so many domains sums have a column each; more are summed as rows.
FLAT = 16


@dataclass
class Mix:
    domains: list
    targets: list[float]
    totals: list[float]
    steps: list[list[float]]
    least: float = 0.0
    met: bool = True


def _words(docs: DataFrame, *keep) -> DataFrame:
    word = F.explode_outer(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")
    return docs.select(*keep, word).where("w <> ''").select(*keep, F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _words_of_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, one, bucket): each word of a text, which id and hash name; ``one`` marks its first word."""
    t = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.split(F.lower(F.ltrim("text", F.lit(" \t\n\x0b\x0c\r"))), r"[\x20\x09-\x0D]+")
    # the hash comes first: no word carries its text along; an inner explode would split each text twice, to filter by size
    w = t.select("doc", F.xxhash64("text").alias("h"), words.alias("ws")).select("doc", "h", F.posexplode_outer("ws").alias("i", "w")).where("w <> ''")
    return w.select("doc", "h", (F.col("i") == 0).cast("long").alias("one"), F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def classifier(docs: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, list[float], DataFrame]:
    """(domains, their log priors, table bucket -> log likelihoods) from all rows with a domain.

    The table has at most BUCKETS rows of as many numbers as there are domains.
    """
    known = docs.where(F.col(domain_col).isNotNull()).select(F.col(domain_col).cast("string").alias("domain"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    domains = sorted(rows)
    total = sum(rows.values())
    priors = [math.log(rows[d] / total) for d in domains]
    if not domains:
        return domains, priors, docs.sparkSession.createDataFrame([], "bucket int, ll array<double>")
    counts = stored(_words(known, "domain").groupBy("bucket", "domain").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    none = counts.select("bucket").distinct().select("bucket", F.explode(F.lit(domains)).alias("domain"), F.lit(0).cast("long").alias("n"))
    cells = counts.union(none).groupBy("bucket", "domain").agg(F.sum("n").alias("n"))
    sums = cells.groupBy("domain").agg((F.sum("n") + F.lit(0.5 * BUCKETS)).alias("s"))
    cells = cells.join(F.broadcast(sums), "domain").select("bucket", F.struct("domain", F.log((F.col("n") + 0.5) / F.col("s")).alias("x")).alias("e"))
    # domains sort alike here and there: by code points are by UTF-8 bytes
    table = cells.groupBy("bucket").agg(F.sort_array(F.collect_list("e")).alias("es")).select("bucket", F.transform("es", lambda e: e.x).alias("ll"))
    table = stored(table, "mix-words")
    discard(counts)
    return domains, priors, table


def posteriors(docs: DataFrame, domains: list, priors: list[float], table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, rows, tokens, p) of every text with words: rows that repeat id and text count in ``rows``. The
    words of all texts meet the table in one pass."""
    t = _words_of_texts(docs, id_col, text_col)
    k = len(domains)
    rows, words = F.sum("one"), F.count(F.lit(1))
    if not k:
        return t.groupBy("doc", "h").agg(rows.alias("rows"), (words / rows).cast("long").alias("tokens")).withColumn("p", F.array().cast("array<double>"))
    # a word with no row in the table is as likely in all domains
    if k <= FLAT:
        w = t.join(F.broadcast(table), "bucket", "left")
        sums = w.groupBy("doc", "h").agg(rows.alias("rows"), words.alias("n"), *[F.sum(F.coalesce(F.col("ll")[i], F.lit(0.0))).alias(f"s{i}") for i in range(k)])
        sums = sums.select("doc", "h", "rows", "n", F.array(*[f"s{i}" for i in range(k)]).alias("s"))
    else:
        w = t.groupBy("doc", "h", "bucket").agg(F.sum("one").alias("one"), words.alias("n")).join(F.broadcast(table), "bucket", "left")
        each = w.select("doc", "h", "one", "n", F.posexplode(F.coalesce("ll", F.lit([0.0] * k))).alias("i", "x"))
        sums = each.groupBy("doc", "h", "i").agg(F.sum("one").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("x"))
        sums = sums.groupBy("doc", "h").agg(F.max("rows").alias("rows"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("es"))
        sums = sums.select("doc", "h", "rows", "n", F.transform("es", lambda e: e.x).alias("s"))
    tokens = (F.col("n") / F.col("rows")).cast("long")
    share = F.lit(float(EVIDENCE)) / (tokens + F.lit(EVIDENCE)) / F.col("rows")
    e = sums.select("doc", "h", "rows", tokens.alias("tokens"), F.zip_with(F.lit(priors), "s", lambda a, x: a + x * share).alias("z")).withColumn("m", F.array_max("z"))
    e = e.withColumn("e", F.transform("z", lambda z: F.exp(z - F.col("m"))))
    e = e.withColumn("d", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return e.select("doc", "h", "rows", "tokens", F.transform("e", lambda x: x / F.col("d")).alias("p"))


def _dot(values: list[float]) -> Column:
    """p . values"""
    if len(values) > FLAT:
        return F.aggregate(F.zip_with("p", F.lit([float(x) for x in values]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    move = F.lit(0.0)
    for k, x in enumerate(values):
        move = move + F.col("p")[k] * F.lit(float(x))
    return move


def _rate(steps: list[list[float]], least: float, start: Column | None = None) -> Column:
    """max(least, ... max(least, max(least, 1) + p . step1) + p . step2 ...): the rate after these steps, or after
    these and what ``start`` holds."""
    rate = F.lit(max(1.0, least)) if start is None else start
    for step in steps:
        rate = F.greatest(F.lit(float(least)), rate + _dot(step))
    return rate


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a . x = b, with a small ridge."""
    m = np.array(a, float)
    return np.linalg.solve(m + 1e-9 * max(np.abs(np.diag(m)).max(initial=0.0), 1e-30) * np.eye(len(b)), np.array(b, float)).tolist()


Targets = Callable[[list[float]], list[float]]


def flattened(power: float = 0.8) -> Targets:
    """Token shares to a power below 1, scaled so that every domain grows by ``GROWTH`` at least."""

    def of(have: list[float]) -> list[float]:
        weight = [h**power if h > 0 else 0.0 for h in have]
        scale = (1 + GROWTH) * max((h / w for h, w in zip(have, weight, strict=True) if w > 0), default=0.0)
        return [scale * w for w in weight]

    return of


def thinned(share: float = 0.001) -> Targets:
    """The tokens there are, with this share for the largest domain and equal shares for the others: the largest shrinks to
    almost nothing, so many of its documents are held at the bound."""

    def of(have: list[float]) -> list[float]:
        most, total = max(range(len(have)), key=lambda i: (have[i], -i)), sum(have)
        rest = (1 - share) / max(len(have) - 1, 1)
        return [total if len(have) == 1 else total * (share if i == most else rest) for i in range(len(have))]

    return of


def fit(post: DataFrame, domains: list, targets: list[float] | Targets | None = None, flatten: float = 0.8, least: float = 0.0, steps: int = 100, tolerance: float = 1e-4) -> Mix:
    """Steps of projected gradient until the expected totals are within ``tolerance`` of the targets, or stand
    still (``STILL``). Near the optimum a scaled step lands on the targets, as long as they can be met."""
    k = len(domains)
    if not k:
        return Mix(domains, [], [], [], least)
    grams: dict[float, list[list[float]]] = {}

    base, begun = post.select("p", (F.col("tokens") * F.col("rows")).alias("t"), F.lit(max(1.0, least)).alias("r0")), 0

    def sums(taken: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """(expected totals, Gram matrix of the documents that are not held at the bound)"""
        r = base.select("p", "t", _rate(taken[begun:], least, F.col("r0")).alias("r"))
        r = r.select("p", (F.col("r") * F.col("t")).alias("w"), F.when((F.col("r") > least) | F.lit(not taken), F.col("t")).otherwise(0).alias("live"))
        full = [[0.0] * k for _ in range(k)]
        if k > FLAT:
            return many(r, full)
        gram = [F.sum(F.col("live") * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(i, k)]
        row = [float(x or 0.0) for x in r.agg(*[F.sum(F.col("w") * F.col("p")[i]) for i in range(k)], *gram).first()]
        at = k
        for i in range(k):
            for j in range(i, k):
                full[i][j] = full[j][i] = row[at]
                at += 1
        return row[:k], full

    def many(r: DataFrame, full: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """The same by rows; the matrix only when other documents are held at the bound, by their tokens, than before."""
        now, live = [0.0] * k, 0.0
        each = r.select("w", "live", F.posexplode("p").alias("i", "x"))
        for i, x, n in each.groupBy("i").agg(F.sum(F.col("w") * F.col("x")), F.sum("live")).collect():
            now[i], live = float(x), float(n)
        if live not in grams:
            each = r.where("live > 0").select("live", "p", F.posexplode("p").alias("i", "x"))
            pairs = each.select("i", (F.col("live") * F.col("x")).alias("x"), F.posexplode(F.slice("p", F.col("i") + 1, F.lit(k))).alias("j", "y"))
            for i, j, x in pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y"))).collect():
                full[i][i + j] = full[i + j][i] = float(x)
            grams.clear()
            grams[live] = full
        return now, grams[live]

    have, gram = sums([])
    if targets is None:
        targets = flattened(flatten)
    if callable(targets):
        targets = targets(have)
    mix = Mix(domains, list(targets), have, [], least)
    if sum(have) <= 0:
        return mix

    def off(now: list[float]) -> float:
        return sum((a - t) ** 2 for a, t in zip(now, mix.targets, strict=True)) ** 0.5

    most = max(float(np.linalg.eigvalsh(np.array(gram)).max()), 1e-30)  # of all documents: bounds every step
    size, near = 1.0, tolerance * max(sum(mix.targets), 1.0)
    for _ in range(steps):
        if off(mix.totals) <= near:
            break
        if len(mix.steps) - begun >= STORE:
            after = stored(base.select("p", "t", _rate(mix.steps[begun:], least, F.col("r0")).alias("r0")), "mix-rates")
            if begun:
                discard(base)
            base, begun = after, len(mix.steps)
        rest = [t - a for a, t in zip(mix.totals, mix.targets, strict=True)]
        plain = size < 0.2
        step = [x / most for x in rest] if plain else [size * x for x in _solve(gram, rest)]
        now, new = sums([*mix.steps, step])
        gain = off(mix.totals) - off(now)
        if gain > STILL * off(mix.totals):
            mix.steps.append(step)
            mix.totals, gram, size = now, new, min(1.0, 2 * size)
        elif plain:
            mix.met = False
            break
        else:
            size /= 2
    else:
        raise RuntimeError(f"rates did not settle in {steps} steps: {off(mix.totals):.4g} tokens from the targets")
    if begun:
        discard(base)
    return mix


def rates(post: DataFrame, mix: Mix) -> DataFrame:
    """doc, h, rows, tokens, p, rate and copies: how often a document is taken."""
    chance = F.pmod(F.xxhash64("doc", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    r = post.select("doc", "h", "rows", "tokens", "p", _rate(mix.steps, mix.least).alias("rate"))
    return r.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(docs: DataFrame, domain_col: str, targets: dict | Targets | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> tuple[DataFrame, Mix]:
    """(rates of the texts that have words, the fit)."""
    domains, priors, table = classifier(docs, domain_col, id_col, text_col)
    named = isinstance(targets, dict)
    unknown = sorted(set(targets if named else {}) - set(domains), key=str)
    if unknown:
        raise ValueError(f"targets for domains that no row has: {unknown[:9]}")
    post = stored(posteriors(docs, domains, priors, table, id_col, text_col), "mix-posteriors")
    if domains:
        discard(table)
    wanted = [float(targets.get(d, 0.0)) for d in domains] if named else targets
    found = fit(post, domains, wanted, least=least)
    return rates(post, found), found


def document_rates(docs: DataFrame, domain_col: str, targets: dict | Targets | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, rate, copies and targets_met of every row of ``docs``."""
    found, fitted = mix(docs, domain_col, targets, id_col, text_col, least)
    found = found.select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), "tokens", "rate", "copies")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rest = max(1.0, least)
    return rows.join(found, rows["doc_id"].eqNullSafe(found["__doc"]) & (rows["h"] == found["__h"]), "left").select(
        "doc_id", F.coalesce("tokens", F.lit(0)).alias("n_tokens"), F.coalesce("rate", F.lit(rest)).alias("rate"), F.coalesce("copies", F.lit(int(rest))).alias("copies"), F.lit(fitted.met).alias("targets_met")
    )


def mixed_documents(docs: DataFrame, domain_col: str, targets: dict | Targets | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns. Targets that are not met are a warning."""
    out, fitted = mixed_with_fit(docs, domain_col, targets, id_col, text_col, least)
    if not fitted.met:
        told = ", ".join(f"{d}: {a:.0f} of {t:.0f}" for d, a, t in zip(fitted.domains, fitted.totals, fitted.targets, strict=True))
        warnings.warn(f"tokens after mixing are not what was asked for: {told}", stacklevel=2)
    return out


def mixed_with_fit(docs: DataFrame, domain_col: str, targets: dict | Targets | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> tuple[DataFrame, Mix]:
    """(the mixed rows, the fit)"""
    found, fitted = mix(docs, domain_col, targets, id_col, text_col, least)
    found = found.select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), F.col("copies").alias("__copies"))
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__doc"]) & (text == found["__h"]), "left")
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce(found["__copies"], F.lit(int(max(1.0, least))))))
    return rows.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), times.alias("time")).select("row.*"), fitted
