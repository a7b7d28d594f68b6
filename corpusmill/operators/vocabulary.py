"""Vocabularies: pre-token dictionary, frequency ranks, coverage, lookups, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pretok import pretokenize, with_prefix_space
from .order import frequency_rank


def pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", prefix_space: bool = False) -> DataFrame:
    """(doc, pieces) of every text."""
    t = F.col(text)
    return docs.select(F.col(doc).alias("doc"), pretokenize(with_prefix_space(t) if prefix_space else t).alias("pieces"))


def dictionary(docs: DataFrame, text: str = "text", prefix_space: bool = False) -> DataFrame:
    """(piece, cnt): how often each pre-token occurs; combined before the one shuffle."""
    t = F.col(text)
    # an inner explode would find the pieces twice, to filter by their number
    each = docs.select(F.explode_outer(pretokenize(with_prefix_space(t) if prefix_space else t)).alias("piece")).where("piece is not null")
    return each.groupBy("piece").agg(F.count(F.lit(1)).alias("cnt"))


def ranked(counts: DataFrame) -> DataFrame:
    """(id, piece, cnt): ids by falling count, then by piece."""
    return frequency_rank(counts, "cnt", "piece", "id").select("id", "piece", "cnt")


def unique_or_fail(vocab: DataFrame, token: str = "token") -> DataFrame:
    """The vocabulary; a token that occurs twice fails the job."""
    twice = vocab.groupBy(token).agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"))
    return twice.select("id", F.when(F.col("n") == 1, F.col(token)).otherwise(F.raise_error(F.concat(F.lit("token occurs twice: "), F.col(token)))).alias(token))


def unknown_runes(docs: DataFrame, vocab: DataFrame, text: str = "text", token: str = "token") -> DataFrame:
    """Distinct characters of the texts that are no token."""
    runes = docs.select(F.explode_outer(F.split(text, "")).alias("rune")).where("rune <> ''").distinct()
    return runes.join(vocab.select(F.col(token).alias("rune")), "rune", "left_anti")


def byte_coverage(alphabet: DataFrame, vocab: DataFrame, symbol: str = "symbol", token: str = "token") -> DataFrame:
    """Symbols of the alphabet that are missing from the vocabulary."""
    return alphabet.join(vocab.select(F.col(token).alias(symbol)), symbol, "left_anti")


def trim(vocab: DataFrame, merges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Tokens with an id below ``size``, and the merges whose product is among them."""
    kept = vocab.where(F.col("id") < size)
    made = merges.withColumn("token", F.concat("left", "right"))
    return kept, made.join(kept.select("token"), "token", "left_semi").select("rank", "left", "right")
