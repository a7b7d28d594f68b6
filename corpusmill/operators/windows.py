"""Overlapping token windows per document, in closed form: stateless, nothing crosses documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pretok import byte_lists
from .order import BLOCK


@dataclass(frozen=True)
class WindowConfig:
    """Length and stride of windows; ``tail`` emits the rest of a document, padded at most on one side."""

    window: int = 1024
    stride: int = 512
    tail: bool = False
    pad_left: bool = False
    pad_right: bool = False
    pad_token: int = 0

    def __post_init__(self) -> None:
        if self.window < 1 or self.stride < 1:
            raise ValueError("window and stride are positive")
        if self.stride > self.window:
            raise ValueError("the stride exceeds the window")
        if self.pad_left and self.pad_right:
            raise ValueError("padding on both sides")

    @property
    def pads(self) -> bool:
        return self.pad_left or self.pad_right

    @staticmethod
    def evaluation(window: int, stride: int, pad_right: bool, pad_token: int = 0) -> WindowConfig:
        """The evaluator's policy: a tail only where it is padded."""
        return WindowConfig(window, stride, pad_right, False, pad_right, pad_token)


def full_windows(length: Column, c: WindowConfig) -> Column:
    return F.when(length >= c.window, F.floor((length - c.window) / F.lit(c.stride)) + 1).otherwise(0).cast("int")


def token_windows(docs: DataFrame, c: WindowConfig, doc: str = "doc", tokens: str = "tokens") -> DataFrame:
    """doc, position, start, tokens, seen, pad_left, pad_right. ``seen`` counts the tokens that an
    earlier window had, as far as the reference's accounting goes: min(start, length, window - stride)."""
    n = full_windows(F.size(tokens), c)
    rows = docs.select(F.col(doc).alias("doc"), F.col(tokens).alias("tokens"), n.alias("n"), F.lit(0).alias("base"), F.size(tokens).alias("total"))
    return _cut(rows.withColumn("position", F.explode(F.sequence(F.lit(0), F.col("n")))), c)


def _cut(w: DataFrame, c: WindowConfig) -> DataFrame:
    """Windows of rows (doc, tokens, n, base, total, position): ``tokens`` begin at ``base`` of a document of ``total``
    tokens and ``n`` full windows, and hold what the window at ``position`` needs."""
    start = F.col("position") * c.stride
    length = F.least(F.lit(c.window), F.greatest(F.col("total") - start, F.lit(0)))
    w = w.withColumn("start", start.cast("int")).withColumn("length", length.cast("int"))
    is_tail = F.col("position") == F.col("n")
    w = w.where((~is_tail) | (F.col("length") > 0) if c.tail else ~is_tail)
    seen = F.least(F.col("start"), F.col("length"), F.lit(c.window - c.stride))
    missing = F.when(is_tail, c.window - F.col("length")).otherwise(0) if c.pads else F.lit(0)
    cut = F.slice("tokens", (F.col("start") - F.col("base") + 1).cast("int"), F.col("length"))
    pad = F.array_repeat(F.lit(c.pad_token), missing)
    cut = F.concat(pad, cut) if c.pad_left else F.concat(cut, pad) if c.pad_right else cut
    zero = F.lit(0)
    return w.select(
        "doc", F.col("position").cast("int").alias("position"), "start", cut.alias("tokens"), seen.cast("int").alias("seen"),
        (missing if c.pad_left else zero).cast("int").alias("pad_left"), (missing if c.pad_right else zero).cast("int").alias("pad_right"),
    )


#: Tokens of a stretch of a document that one row holds, at least, when documents arrive in chunks.
STRETCH = 1 << 14


def chunk_offsets(chunks: DataFrame, doc: str, order: str, length: Column, block: int = BLOCK) -> DataFrame:
    """(doc, order, at, total): where each chunk of a document begins, and the document's length. Sums are taken by blocks
    of an integer order first, so a document of very many chunks is many tasks."""
    b = F.floor(F.col(order) / F.lit(block))
    d = chunks.select(F.col(doc).alias("doc"), F.col(order).alias("order"), b.alias("block"), length.cast("long").alias("length"))
    sums = d.groupBy("doc", "block").agg(F.sum("length").alias("sum"))
    of_doc = Window.partitionBy("doc")
    sums = sums.select(
        F.col("doc").alias("of"), F.col("block").alias("b"),
        F.coalesce(F.sum("sum").over(of_doc.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("sum").over(of_doc).alias("total"),
    )
    inner = Window.partitionBy("doc", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("length").over(inner), F.lit(0)))
    d = d.join(sums, d["doc"].eqNullSafe(sums["of"]) & d["block"].eqNullSafe(sums["b"]))
    return d.select("doc", "order", (F.col("before") + F.col("inner")).alias("at"), "total")


def chunked_windows(chunks: DataFrame, c: WindowConfig, doc: str = "doc", order: str = "chunk", tokens: str = "tokens", stretch: int = STRETCH) -> DataFrame:
    """The windows of documents that arrive as chunks (doc, chunk, tokens), as ``token_windows`` would cut them whole.

    No document is put together: its tokens are dealt to stretches of at least ``stretch`` tokens (a multiple of the stride),
    each with a halo of the ``window - 1`` tokens that follow, and a stretch cuts the windows that begin in it. Chunks may
    be empty or null, and a chunk may be longer than a stretch. ``chunk`` is an integer that occurs once in a document.
    A binary column of tokens stands for its bytes, which are shuffled as bytes and become numbers after.
    """
    raw = isinstance(chunks.schema[tokens].dataType, T.BinaryType)
    length, slice_ = (F.octet_length, F.substring) if raw else (F.size, F.slice)
    size = -(-max(stretch, c.window) // c.stride) * c.stride
    d = chunks.where(length(tokens) > 0).select(F.col(doc).alias("doc"), F.col(order).alias("order"), F.col(tokens).alias("tokens"))
    at = chunk_offsets(d, "doc", "order", length("tokens")).toDF("of", "o", "at", "total")
    d = d.join(at, d["doc"].eqNullSafe(at["of"]) & (d["order"] == at["o"]))
    end = F.col("at") + length("tokens")
    # a stretch's halo reaches window - 1 tokens into the next ones
    first = F.greatest(F.lit(0), F.floor((F.col("at") - (c.window - 1)) / F.lit(size)))
    d = d.withColumn("stretch", F.explode(F.sequence(first, F.floor((end - 1) / F.lit(size)))))
    low = F.greatest(F.col("at"), F.col("stretch") * size)
    high = F.least(end, (F.col("stretch") + 1) * size + (c.window - 1))
    part = F.struct(low.alias("at"), slice_("tokens", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("tokens"))
    g = d.where(high > low).groupBy("doc", "stretch", "total").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    parts = F.transform("parts", lambda p: p["tokens"])
    g = g.select("doc", "total", (F.col("stretch") * size).alias("base"), (parts if raw else F.flatten(parts)).alias("tokens"))
    g = byte_lists(g, "tokens") if raw else g
    g = g.withColumn("n", full_windows(F.col("total"), c).cast("long"))
    low, high = (F.col("base") / F.lit(c.stride)).cast("long"), ((F.col("base") + size) / F.lit(c.stride)).cast("long") - 1
    g = g.where(low <= F.col("n")).withColumn("position", F.explode(F.sequence(low, F.least(high, F.col("n")))))
    return _cut(g, c)


def jobs(windows: DataFrame) -> DataFrame:
    """Windows as scoring jobs: the first token of a document is context only."""
    return windows.withColumn("seen", F.greatest("seen", F.lit(1)))


def _scoring_windows(c: WindowConfig, length: str, pos: str) -> tuple[Column, Column]:
    """First and last window that hold the token at ``pos`` (last below first: none)."""
    p, n = F.col(pos), full_windows(F.col(length), c)
    low = F.greatest(F.lit(0), F.ceil((p - c.window + 1) / F.lit(c.stride))).cast("int")
    return low, F.least(F.floor(p / F.lit(c.stride)).cast("int"), n if c.tail else n - 1)


def _counts_in(window: Column, c: WindowConfig, length: str, pos: str) -> Column:
    """Whether the token is scored in a window that holds it."""
    start = window * c.stride
    size = F.least(F.lit(c.window), F.col(length) - start)
    seen = F.greatest(F.least(start, size, F.lit(c.window - c.stride)), F.lit(1))
    return F.col(pos) - start >= seen


def scored_positions(tokens: DataFrame, c: WindowConfig, length: str = "length", pos: str = "pos", dedupe: bool = False) -> DataFrame:
    """One row for each time a token (at ``pos`` of ``length``) is scored, with the window's position.

    The windows of a token are an interval of positions, so no window array is built. With
    ``dedupe`` a token counts in its first window only.
    """
    low, high = _scoring_windows(c, length, pos)
    w = tokens.where(high >= low).withColumn("position", F.explode(F.sequence(low, high)))
    w = w.where(_counts_in(F.col("position"), c, length, pos))
    if dedupe:
        w = w.where(F.col("position") == low)
    return w


def times_scored(c: WindowConfig, length: str = "length", pos: str = "pos") -> Column:
    """How often a token is scored, as one expression: a token is in few windows, last ones first."""
    low, high = _scoring_windows(c, length, pos)
    total = F.lit(0)
    for back in range(-(-c.window // c.stride)):
        k = high - back
        total = total + F.when((k >= low) & _counts_in(k, c, length, pos), 1).otherwise(0)
    return total
