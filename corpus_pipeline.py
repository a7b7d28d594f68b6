"""The corpus pipeline: five stages over whole documents, each written and read again.

Quality classifier, exact dedup, n-gram Jaccard join, mixing to target weights, BPE. Each stage
takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``. Mixing repeats documents of small languages and drops none.

Defined results: a null text is an empty one in every stage; rows without an id are scored, compared as exact
copies, taken as alone in the n-gram join, mixed and encoded; of rows that repeat id and text the exact stage
leaves one; an empty table gives an empty table; further columns go through all stages but the last, whatever
their names; long texts are whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, exact_dedup, mixing, ngram_join, quality
from corpusmill.llm.common import discard, stored
from corpusmill.llm.queries import tokenizer_path

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it is fitted on labelled rows of this stage's input."""
    machine = quality.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, machine, LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, similarity 0.75) stays."""
    return ngram_join.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that expected tokens by language meet the flattened targets, at rates from 1 on; a fit that
    does not meet them is a warning with the totals."""
    return mixing.mixed_documents(docs, "lang", least=1.0)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the classifier, the similarity join, the fit and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one's is written."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
