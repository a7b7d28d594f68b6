import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import licenses
from corpusmill.llm.licenses import SLACK, TEMPLATES, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text, templates=TEMPLATES):
    """Everything that ``scan`` tells of a text, template by template and place by place."""
    w = WORD.findall((text or "").translate(LOWER))
    starts, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        words = t.words.split(" ")
        n = len(words) - 1
        on = {}
        for p in range(len(w) - 1):
            for k in range(n):
                if (w[p], w[p + 1]) == (words[k], words[k + 1]):
                    on.setdefault(p - k, set()).add(k)
        for d, hit in on.items():
            share = len(set().union(*(on.get(d + s, ()) for s in range(SLACK + 1)))) / n
            score = max(score, share)
            if t.phrase and len(hit) == n:
                assert w[d : d + len(words)] == words
                starts.append(d)
                base.add(t.label)
            if len(hit) == n if t.phrase else share >= 0.75:
                labels.add(t.label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scanned(spark, rows, templates=TEMPLATES):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df, templates).collect()
    return sorted(map(str, (tuple(r) for r in got)))


def expected(rows, templates=TEMPLATES):
    return sorted(str((i, *plain(t, templates))) for i, t in rows)


def test_places_ties_and_hostile_rows(spark):
    rows = [
        (1, "CC BY, all Rights reserved; all rights reserved! cc by"),
        (2, None),
        (2, ""),
        (3, "cc"),
        (None, "General Public License"),
        (None, "General Public License"),
        (4, "cc by"),
        (4, "cc by"),
        (4, "gnu cc-by"),
        (5, "K cc by ſource café GENERAL PUBLIC LICENSE İ"),
        (6, "cc by" + " word" * 60_000 + " all rights reserved"),
        (7, "ccby general public licence all rights\x7freserved [cc`by{cc@by"),
    ]
    assert scanned(spark, rows) == expected(rows)


def test_templates_with_left_out_and_added_words(spark):
    bsd = next(t.words for t in TEMPLATES if t.label == "bsd-text").split(" ")
    rows = [(0, " ".join(bsd)), (1, " ".join(bsd[:8] + bsd[9:])), (2, " ".join([*bsd[:8], "also", *bsd[8:]])), (3, " ".join(bsd[:9])), (4, " ".join(bsd[::-1]))]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scanned(spark, rows) == expected(rows)
    assert got[0] == ("bsd-text", 1.0) and got[1][0] == got[2][0] == "bsd-text" and got[1][1] < 1 and got[3][0] == got[4][0] == ""


def test_random_texts_of_few_words(spark):
    rng = random.Random(5)
    templates = (Template("p", "a b", True), Template("q", "a b a c", True), Template("t", "a b c a b b c"), Template("u", "b b b b"))
    rows = [(k % 50, " ".join(rng.choices("abc", k=rng.randrange(30)))) for k in range(300)]
    assert scanned(spark, rows, templates) == expected(rows, templates)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).collect() == []
    odd = spark.createDataFrame([(1, "cc by", 5, "x", 2, 3)], "doc_id long, text string, copies int, own string, tid int, score int")
    assert [tuple(r) for r in licenses.scan(odd).collect()] == [(1, 2, 1, 0, 0, "cc-by", "cc-by", 1.0)]
    with pytest.raises(ValueError, match="2 to 65"):
        licenses.scan(empty, (Template("x", "one"),))


def test_plan_is_native(spark):
    df = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


def test_copies_of_one_row_in_several_partitions(spark):
    df = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("under cc by").alias("text")).repartition(5)
    assert {tuple(r) for r in licenses.scan(df).collect()} == {(7, 3, 1, 1, 1, "cc-by", "cc-by", 1.0)}
    assert licenses.scan(df).count() == 1000
