"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups.

Native: DataFrame functions only. The normalised text is hashed with MD5 (128 bits); rows are grouped
by the hash *and* the normalised bytes, so that two texts with one hash stay apart. Size and place in the group are
one number each, so the grouping hashes and sorts no texts, and it is combined on the map side: a hot group of copies
reaches the shuffle as one row for each map task.

Rows find their group again through light columns only (MD5 and SHA-256 of the normalised text). Rows without a copy need no
group. Groups of more than ``HOT`` rows, of which there are few, are broadcast after a look at their number, so
their rows meet them where they are; the other rows are spread evenly in the join that is left.

Defined results: a null text is an empty text; a null id loses every tie and has ``kept`` true only
where all ids of the group are null; rows that repeat an id within a group share its fate in
``exact_groups``, while ``drop_exact_duplicates`` leaves one row of each group; an empty
table gives an empty table; further columns, whatever their names, do not matter; long texts are strings like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Characters that do not count, ``[\x20\x09-\x0D]``.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("id", F.length("t").alias("len"), normalised(F.col("t")).alias("norm"))
    return d.withColumn("b", F.col("norm").cast("binary"))


#: Rows of a group that is broadcast, and how many such groups there may be for that.
HOT, HOT_GROUPS = 4096, 100_000


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _rank(length: Column, id_: Column) -> Column:
    """Length and id as one number: the largest is the longest text's, then the smallest id's, then a null id's."""
    back = F.coalesce(_whole(2**63) - id_.cast("decimal(20,0)"), _whole(0))
    return (length.cast("decimal(10,0)") * _whole(2**65) + back).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    back = rank % _whole(2**65)
    return F.when(back > 0, (_whole(2**63) - back).cast("long"))


def copied_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, text_sha256, group_size, keep_id) of texts that two rows have, or that share their hash with another text."""
    d = _hashed(docs, id_col, text_col)
    g = d.select(F.unhex(F.md5("b")).alias("h"), "b", _rank(F.col("len"), F.col("id")).alias("rank"))
    g = g.groupBy("h", "b").agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("rank"))
    return g.where("group_size > 1").select("h", F.unhex(F.sha2("b", 256)).alias("sha"), "group_size", _ranked_id(F.col("rank")).alias("keep_id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest id.
    """
    groups = stored(copied_groups(docs, id_col, text_col), "exact-groups")
    rows = _hashed(docs, id_col, text_col).select("id", F.unhex(F.md5("b")).alias("h"), F.unhex(F.sha2("b", 256)).alias("sha"))
    size, keep = F.col("group_size"), F.col("keep_id")
    hot = groups.where(size > HOT)
    if 0 < hot.count() <= HOT_GROUPS:
        hot = hot.toDF("h", "sha", "hot_size", "hot_id")
        rows = rows.join(F.broadcast(hot), ["h", "sha"], "left")
        # rows of a hot group look for no other: a key of their own spreads them
        rows = rows.withColumn("h", F.when(F.col("hot_size").isNull(), F.col("h")).otherwise(F.concat("h", F.coalesce("id", F.lit(0)).cast("string").cast("binary"))))
        groups = groups.where(size <= HOT)
        size, keep = F.coalesce("hot_size", "group_size"), F.when(F.col("hot_size").isNull(), keep).otherwise(F.col("hot_id"))
    keep = F.when(size.isNull(), F.col("id")).otherwise(keep)
    found = rows.join(groups, ["h", "sha"], "left").select("id", "sha", F.coalesce(size, F.lit(1)).alias("group_size"), keep.alias("keep_id"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: the one with the most code points, then the smallest
    id; rows that tie in both are ordered by the hash of their text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    order = F.struct(F.length(text).alias("len"), F.bitwise_not(docs[id_col]).alias("back"), F.md5(text.cast("binary")).alias("md5"))
    d = docs.select(normalised(docs[text_col]).alias("norm"), order.alias("order"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    best = d.withColumn("h", F.md5(F.col("norm").cast("binary"))).groupBy("h", "norm").agg(F.max_by("row", "order").alias("row"))
    return best.select("row.*")
