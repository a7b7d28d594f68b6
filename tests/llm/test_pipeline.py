import corpus_pipeline
from corpusmill.llm import quality
from corpusmill.llm.queries import QUERIES, SQL

from .brute import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        kept[name] = [r.asDict() for r in out.collect()]
        docs = spark.createDataFrame(kept[name], start.schema)
    rows = {r.doc_id: r for r in start.collect()}
    # quality: what the classifier scores below the limit goes, the rest stays
    m = quality.fit_labelled(start, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(start, m).collect() if r.score >= corpus_pipeline.LEAST_QUALITY}
    assert {r["doc_id"] for r in kept["quality"]} == good
    # exact: one of each group of texts that are equal without white space
    norm = lambda t: "".join((t or "").split(" ")).translate({c: None for c in range(9, 14)})
    best = {}
    for d in good:
        best.setdefault(norm(rows[d].text), []).append((-len(rows[d].text or ""), d))
    assert {r["doc_id"] for r in kept["exact_dedup"]} == {min(x)[1] for x in best.values()}
    # near: the smallest id of each component
    comp = jaccard_components([(r["doc_id"], r["text"]) for r in kept["exact_dedup"]])
    assert {r["doc_id"] for r in kept["ngram_join"]} == {c for _, c in comp.values()}
    # mixing drops nothing
    assert {r["doc_id"] for r in kept["mixing"]} == {r["doc_id"] for r in kept["ngram_join"]}
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r["doc_id"] for r in kept["mixing"])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_on_hostile_rows(spark):
    """Nulls in all columns, empty and long texts, repeated rows and ids, clashing names; and no rows at all."""
    start = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in start.orderBy("doc_id").limit(3).collect()]
    long = " ".join(f"word{k % 7919}" for k in range(150_000))
    rows = [(None, None, None), (1, None, None), (1, "", "en"), (2, good[0], "en"), (2, good[0], "en"), (None, good[0], None), (3, good[1], "de"), (3, good[2], "xx"), (4, long, "en"), (5, long + " end", None)]
    docs = spark.createDataFrame([(*r, None, None, 1, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tokens int, component string")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, SF)
            found = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns
            if name in ("quality", "exact_dedup", "ngram_join"):
                assert len(found) <= at.count() and {r.text for r in found} <= {r[1] for r in rows}
            if name == "exact_dedup":
                norm = ["".join((r.text or "").split()) for r in found]
                assert len(norm) == len(set(norm))
            if name == "bpe":
                assert len(found) == at.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                at = spark.createDataFrame(found, docs.schema)
