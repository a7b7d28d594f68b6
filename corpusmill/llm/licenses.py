"""License scans by diagonal voting: where a text runs along a template, its word grams meet the template's on one diagonal.

Native: DataFrame functions only. All rolling k-gram hashes of the texts' words join the positions of the templates' grams
(a table of as many rows as the templates have words, which is broadcast). A hit at word ``p`` and template position ``t``
votes for diagonal ``p - t``: a place where the whole template would begin. Votes of a place are a bitmap of template
positions, so repeated hits count once, and are combined before they are shuffled. Neighbouring diagonals, up to
``SLACK`` words on, are merged: words that a text leaves out or puts in move what follows to the next diagonals.
Verified are the words themselves (a hit needs equal words, not only equal hashes) and the span: a phrase needs all of
its grams on one diagonal, a template the share ``LEAST`` of them within the merged diagonals.

Phrases are templates that must be whole. Templates have 2 to 64 grams each; longer ones are given in parts.

Defined results: a null text is empty and has no words; a text without a gram has no labels and score 0; rows that
repeat an id, a text or both are rows of the result each; a null id is kept; very long texts are scanned whole; an empty
table gives an empty table; further columns, whatever their names, do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a gram. The shortest phrase has two words.
GRAM = 2
#: How many words further a diagonal may be and still be of one place.
SLACK = 2
#: The least share of a template's grams that a place needs.
LEAST = 0.75
#: Grams of all templates up to which they are broadcast.
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    """Words in lower case, one space between; ``phrase``: only whole places count."""

    label: str
    words: str
    phrase: bool = False


# The phrases of the task, and first sentences of public licenses and their notices.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
NOTICES = (
    Template("apache-notice", "licensed under the apache license version 2 0"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-notice", "licensed under cc by nc 4 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
)
TEMPLATES = PHRASES + NOTICES


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A to Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(words: Column) -> Column:
    """Each word with the ``GRAM - 1`` words after it (null beyond the end)."""
    zipped = F.arrays_zip(words.alias("w0"), *[F.slice(words, k + 1, F.size(words)).alias(f"w{k}") for k in range(1, GRAM)])
    fields = ", ".join(f"w{k}: string" for k in range(GRAM))
    return zipped.cast(f"array<struct<{fields}>>")


def _gram_hash(prefix: str = "g.") -> Column:
    return F.xxhash64(*[F.col(f"{prefix}w{k}") for k in range(GRAM)])


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(tid, place, key, a0, a1): one row for each gram of each template."""
    lengths = [len(t.words.split(" ")) - GRAM + 1 for t in templates]
    if not templates or min(lengths) < 1 or max(lengths) > 64:
        raise ValueError("a template has 2 to 65 words")
    rows = F.array(*[F.struct(F.lit(k).alias("tid"), F.lit(t.words).alias("words")) for k, t in enumerate(templates)])
    t = spark.range(1).select(F.inline(rows)).select("tid", F.posexplode(grams(F.split("words", " "))).alias("place", "g"))
    out = t.where(f"g.w{GRAM - 1} is not null").select("tid", "place", _gram_hash().alias("key"), *[F.col(f"g.w{k}").alias(f"a{k}") for k in range(GRAM)])
    return F.broadcast(out) if sum(lengths) <= BROADCAST_GRAMS else out


def votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own, n_words, tid, diagonal, mask, copies): the template positions that a document has on each diagonal.

    ``own`` tells the rows of ``docs`` apart: id, hashes of the text and input partition; equal rows of a partition are
    ``copies`` of one. A row without a template stands for the document itself.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = F.struct("doc_id", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.spark_partition_id().alias("part"))
    d = d.select(own.alias("own"), words(F.col("text")).alias("words")).select("own", F.size("words").cast("long").alias("n_words"), grams(F.col("words")).alias("grams"))
    nothing = F.array(F.lit(None).cast(f"struct<{', '.join(f'w{k}: string' for k in range(GRAM))}>"))
    d = d.select("own", "n_words", F.posexplode(F.concat(nothing, "grams")).alias("at", "g"))
    d = d.where((F.col("at") == 0) | F.col(f"g.w{GRAM - 1}").isNotNull()).withColumn("key", F.when(F.col("at") > 0, _gram_hash()))
    hit = d.join(template_grams(docs.sparkSession, templates), "key", "left")
    equal = F.lit(True)
    for k in range(GRAM):
        equal = equal & (F.col(f"g.w{k}") == F.col(f"a{k}"))
    hit = hit.where((F.col("at") == 0) | equal)
    diagonal = (F.col("at") - 1 - F.col("place")).cast("long")
    return hit.groupBy("own", "n_words", "tid", diagonal.alias("diagonal")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("mask"), F.count_if(F.col("at") == 0).alias("copies")
    )


def places(voted: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``votes`` with label, phrase, whole (all grams on the diagonal) and share (of the grams, on it and its neighbours)."""

    def of(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("tid"))

    n = of([len(t.words.split(" ")) - GRAM + 1 for t in templates])
    w = Window.partitionBy("own", "tid").orderBy("diagonal").rangeBetween(0, SLACK)
    merged = F.bit_or("mask").over(w)
    return voted.select(
        "*",
        of([t.label for t in templates]).alias("label"),
        of([t.phrase for t in templates]).alias("phrase"),
        (F.bit_count("mask") == n).alias("whole"),
        (F.bit_count(merged).cast("double") / n).alias("share"),
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` and the words count the places of phrases; ``labels`` are of phrases and templates; ``score`` is the largest
    share of any.
    """
    p = places(votes(docs, templates, id_col, text_col), templates)
    base = F.coalesce(F.col("phrase") & F.col("whole"), F.lit(False))
    found = base | F.coalesce(~F.col("phrase") & (F.col("share") >= LEAST), F.lit(False))

    def listed(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    out = p.groupBy("own", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(found).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("own.doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
