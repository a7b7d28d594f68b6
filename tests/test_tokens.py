import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import bytelevel
from corpusmill.functions.pretok import byte_tokens, pretokenize, repair_bytes, repaired, rune_class, with_prefix_space
from corpusmill.operators import bpe, bpe_flat, bpe_training, vocabulary
from corpusmill.sources.scratch import scratch


def pieces(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.p for r in df.select("k", pretokenize(F.col("t")).alias("p")).orderBy("k").collect()]


def test_golden_pieces(spark):
    got = pieces(spark, "The quick brown fox jumps over the lazy dog's back.", "foo", " ", "\n", "   bar", "")
    assert got[0] == ["The", " quick", " brown", " fox", " jumps", " over", " the", " lazy", " dog", "'s", " back", "."]
    assert got[1:] == [["foo"], [" "], ["\n"], ["  ", " bar"], []]


def test_pieces_against_the_library(spark):
    from tokenizers import pre_tokenizers

    rng = random.Random(4)
    alphabet = list(" \t\r\n  　​abstrevmld'09٣Ⅷ½😀é中.!") + ["'s", "'re", " 's", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    lib = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for t, got in zip(texts, pieces(spark, *texts), strict=True):
        assert "".join(got) == t
        assert [bytelevel.to_symbols(p.encode()) for p in got] == [p for p, _ in lib.pre_tokenize_str(t)]


def test_repair(spark):
    assert repair_bytes(b"\xa2\x9d") == "��" and repair_bytes(b"\xef") == "�"
    assert repair_bytes("né".encode() + b"\xe4\xb8") == "né��"
    assert repair_bytes(b"\xff" * 200_000) == "\ufffd" * 200_000 and repair_bytes(b"\xed\xa0\x80") == "\ufffd" * 3
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xa2x")), (3, None)], "k int, b binary")
    assert [r.b for r in repaired(df, "b").orderBy("k").collect()] == ["ok", "�x", None]


def test_classes_and_prefix(spark):
    df = spark.createDataFrame([(c,) for c in " \tA9."], "c string")
    assert [r[0] for r in df.select(rune_class(F.col("c"))).collect()] == ["space", "whitespace", "letter", "number", "other"]
    df = spark.createDataFrame([("",), ("a",), (" a",)], "c string")
    assert [r[0] for r in df.select(with_prefix_space(F.col("c"))).collect()] == ["", " a", " a"]


def test_alphabet(spark):
    order = bytelevel.initial_alphabet()
    assert len(set(order)) == 256 and [ord(order[k]) for k in range(177, 188)] == list(range(0xF5, 0x100))
    assert bytelevel.from_symbols(bytelevel.to_symbols(bytes(range(256)))) == bytes(range(256))
    rows = bytelevel.alphabet_table(spark).orderBy("idx").collect()
    assert [r.symbol for r in rows] == order
    df = spark.createDataFrame([(bytearray(b" a"),)], "b binary")
    assert df.select(bytelevel.mapped(F.col("b"))).first()[0] == "Ġa"
    assert bpe.unused_by_design() == list(range(177, 188))


def test_byte_tokens(spark):
    df = spark.createDataFrame([(1, "aé"), (2, None), (3, "")], "k long, t string")
    assert {r.doc: r.tokens for r in byte_tokens(df, "k", "t").collect()} == {1: [97, 195, 169], 2: [], 3: []}


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame([("low lower lowest low low newer wider new new",)], "text string")
    return bpe.train(vocabulary.dictionary(df, prefix_space=True), 280, least=1)


def test_train_encode_decode(spark, trained, tmp_path):
    assert len(trained.vocab) == 256 + len(trained.merges) <= 280
    df = spark.createDataFrame([(1, "low newest wide\n"), (2, ""), (3, "中")], "doc_id long, text string")
    ids = bpe.encode(df, trained)
    assert {r.doc: r.text for r in bpe.decode(ids, trained).collect()} == {1: "low newest wide\n", 2: "", 3: "中"}
    trained.save(str(tmp_path / "v.json"), str(tmp_path / "m.txt"))
    again = bpe.Tokenizer.from_files(str(tmp_path / "v.json"), str(tmp_path / "m.txt"))
    assert again.vocab == trained.vocab and again.merges == trained.merges


def test_training_takes_the_most_frequent_pair(spark):
    """Counted anew before each merge; ties go to the smaller pair."""
    rng = random.Random(7)
    counts = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 5) for _ in range(60)}
    got = bpe.train(spark.createDataFrame(list(counts.items()), "piece string, cnt long"), 256 + 40, least=1).merges
    words, want = [(list(w), n) for w, n in counts.items()], []
    while len(want) < 40:
        seen = {}
        for parts, n in words:
            for p in zip(parts, parts[1:], strict=False):
                seen[p] = seen.get(p, 0) + n
        if not seen:
            break
        best = min(seen, key=lambda p: (-seen[p], p))
        want.append(best)
        for parts, _ in words:
            k = 0
            while k + 1 < len(parts):
                if (parts[k], parts[k + 1]) == best:
                    parts[k : k + 2] = ["".join(best)]
                k += 1
    assert list(got) == want


def test_same_ids_as_the_library(spark, trained, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    lib = Tokenizer(models.BPE(dict(trained.vocab), list(trained.merges)))
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    text = "lower lowlow newnewer aaa wides\nlowest"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.encode(df, trained).first().tokens == lib.encode(text).ids


def test_long_and_repetitive_pieces(trained):
    """Ids equal those of merging the lowest rank everywhere, pair by pair."""

    def plain(text):
        parts = list(bytelevel.to_symbols(text.encode()))
        while found := [(trained.ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in trained.ranks]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [trained.vocab[p] for p in parts]

    rng = random.Random(2)
    for text in ["", "l", "lowlowlowerlowest" * 9, "wwwwww", *("".join(rng.choice("lowernst i") for _ in range(rng.randrange(1, 60))) for _ in range(200))]:
        assert trained.piece(text) == plain(text)
    assert len(trained.piece("lower" * 100_000)) > 0


def test_unknown_symbols(spark, trained):
    few = bpe.Tokenizer({s: i for s, i in trained.vocab.items() if s != "z"}, trained.merges, recover=True)
    df = spark.createDataFrame([(1, "low zoo"), (2, "low")], "doc_id long, text string")
    got = {r.doc: r.tokens for r in bpe.encode(df, few).collect()}
    assert got[1] == [] and got[2]
    strict = bpe.Tokenizer(few.vocab, few.merges)
    with pytest.raises(Exception, match="unknown symbol"):
        bpe.encode(df, strict).collect()


def test_reachability_and_trim(spark):
    base = {s: k for k, s in enumerate(bytelevel.initial_alphabet())}
    vocab = {**base, "ab": 256, "abc": 257, "xyz": 258, "bc": 259}
    t = bpe.Tokenizer(vocab, (("ab", "c"), ("a", "b"), ("a", "bc"), ("b", "c"), ("ab", "c")))
    reach = bpe.reachable(t.vocab, t.merges)
    assert "abc" in reach and "xyz" not in reach
    m = {(r.rank): r.reachable for r in bpe.reachable_merges(t, spark).collect()}
    assert m == {0: True, 1: True, 2: True, 3: True, 4: True}
    assert [r.id for r in bpe.unused_tokens(t, spark).collect()] == [258]
    cut, config = bpe.trim_tokenizer(t, 257, "vocab_size=260 and 2600")
    assert set(cut.vocab) == set(base) | {"ab"} and cut.merges == (("a", "b"),) and config == "vocab_size=257 and 2600"
    v, merges = vocabulary.trim(t.table(spark), t.merge_table(spark), 257)
    assert v.count() == 257 and [(r.left, r.right) for r in merges.collect()] == [("a", "b")]
    with pytest.raises(Exception, match="twice"):
        vocabulary.unique_or_fail(spark.createDataFrame([(1, "a"), (2, "a")], "id long, token string")).collect()


def test_vocabulary_order(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("zz", 5), ("é", 1), ("ab", 2)], "piece string, cnt long")
    assert [(r.id, r.piece) for r in vocabulary.ranked(counts).orderBy("id").collect()] == [(0, "zz"), (1, "a"), (2, "ab"), (3, "b"), (4, "é")]


# ---------------------------------------------------------------- training over a table


@pytest.mark.parametrize("letters, hot, rewrite", [("ab", 4, 1), ("abc", 6, 3), ("abcd", 30_000, 16), ("a", 2, 2)])
def test_table_training_equals_plain_training(spark, letters, hot, rewrite):
    """Also where few counts are known, all counts tie and pairs overlap themselves."""
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))): rng.choice([1, 1, 2, 7]) for _ in range(50)}
    df = spark.createDataFrame(list(counts.items()), "piece string, cnt long")
    plain = bpe.train(df, 256 + 30, least=1)
    got = bpe_training.train(df, 256 + 30, least=1, hot=hot, rewrite=rewrite)
    assert got.merges == plain.merges and got.vocab == plain.vocab


def test_table_training_of_documents_and_tables_left(spark):
    df = vocabulary.dictionary(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), prefix_space=True)
    plain = bpe.train(df, 256 + 40, least=1)
    root = os.path.dirname(scratch(spark)).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert bpe_training.train(df, 256 + 40, least=1).merges == plain.merges
    assert set(os.listdir(root)) == before
    empty = bpe_training.train(df.where("false"), 300)
    assert empty.merges == () and len(empty.vocab) == 256


def test_batches_are_prefixes_that_do_not_touch():
    names = list("abcdef")
    counts = {(0, 1): 9, (2, 3): 8, (4, 5): 7, (1, 2): 6}
    assert [b[:2] for b in bpe_training.select_batch(counts, names, set(names), 9)] == [(0, 1), (2, 3), (4, 5)]
    assert len(bpe_training.select_batch(counts, names, set(names), 2)) == 2
    # (b, e) ties with (c, d): merging (a, b) may leave (ab, e) with that count and a smaller name
    assert [b[:2] for b in bpe_training.select_batch({(0, 1): 9, (2, 3): 8, (1, 4): 8}, names, set(names), 9)] == [(0, 1)]
    assert [b[:2] for b in bpe_training.select_batch({(0, 0): 9, (2, 3): 8}, names, set(names), 9)] == [(0, 0)]
    assert [b[:2] for b in bpe_training.select_batch({(0, 1): 9, (2, 3): 8}, names, {*names, "ab"}, 9)] == [(0, 1)]


def test_alpha_weighs_pairs_across_segments(spark):
    df = spark.createDataFrame([("unfold", 10, [2]), ("nfa", 3, [])], "piece string, cnt long, cuts array<int>")
    assert ("n", "f") in bpe_training.train(df, 256 + 8, least=1).merges
    assert bpe_training.train(df, 256 + 1, least=1, alpha=0.0).merges == (("n", "f"),)
    strict = bpe_training.train(df, 256 + 8, least=1, alpha=1.0)
    assert not any(p in strict.merges for p in [("u", "nf"), ("un", "fo"), ("un", "fold")])
    half = bpe_training.train(df, 256 + 1, least=1, alpha=0.5)
    assert half.merges == (("f", "o"),)
    with pytest.raises(ValueError, match="alpha"):
        bpe_training.train(df, 300, alpha=2)


def test_wrong_guesses_change_no_merge(spark, monkeypatch):
    """Guesses from one piece that says nothing of the others, and in small batches."""
    monkeypatch.setattr(bpe_training, "HEAD", 1)
    monkeypatch.setattr(bpe_training, "HELD", 8)
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))): rng.choice([1, 1, 2, 7]) for _ in range(60)} | {"zzzzyzyzy": 500}
    df = spark.createDataFrame(list(counts.items()), "piece string, cnt long").repartition(3)
    assert bpe_training.train(df, 256 + 40, least=1).merges == bpe.train(df, 256 + 40, least=1).merges


def test_pieces_are_rows_by_the_block(spark):
    df = spark.range(5000).select(F.concat(F.lit("w"), F.col("id")).alias("piece"), F.lit(2).cast("long").alias("cnt")).coalesce(1)
    assert bpe_training.symbol_table(df, 1).count() == 1
    assert sum(r.n for r in bpe_training.pair_counts(bpe_training.symbol_table(df, 1)).collect()) == bpe_training.UNIT * 2 * sum(len(str(k)) for k in range(5000))


# ---------------------------------------------------------------- flat merges


def merged_one_by_one(pieces, merges):
    t = bpe_flat.MergeTable(merges)
    return [t.one(list(p.encode())) for p in pieces]


def merged_flat(pieces, merges):
    data = np.frombuffer("".join(pieces).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(p.encode()) for p in pieces])])
    sym, ends = bpe_flat.MergeTable(merges)(data, offs)
    return [sym[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_flat_merges_of_lists_in_any_order(trained):
    """Lists whose products are used before they are made, too."""
    rng = random.Random(11)
    for trial in range(150):
        merges, made = [], list("ab")
        for _ in range(rng.randrange(1, 9)):
            a, b = rng.choice(made), rng.choice(made)
            merges.append((a, b))
            made.append(a + b)
        rng.shuffle(merges)
        pieces = ["".join(rng.choice("abc"[: 2 + trial % 2]) for _ in range(rng.randrange(0, 25))) for _ in range(40)] + ["ab" * 200, "", "a" * 300]
        t = bpe.Tokenizer({s: k for k, s in enumerate(dict.fromkeys([*bytelevel.initial_alphabet(), *(a + b for a, b in merges)]))}, tuple(merges))
        got = merged_flat(pieces, merges)
        assert got == merged_one_by_one(pieces, merges)
        names = bpe_flat.MergeTable(merges).symbols
        assert [[t.vocab[names[x]] for x in g] for g in got] == [t.piece(p) for p in pieces]


def test_ids_of_a_public_vocabulary(spark):
    """Ids equal the library's for the files given; no exchange in the plan."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, t = Tokenizer.from_file(path), bpe.Tokenizer.from_json(path)
    lib.no_truncation()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = bpe.encode(docs, t)
    assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc: r.tokens for r in ids.collect()}
    assert len(got) == len(texts)
    for d, text in texts.items():
        assert got[d] == lib.encode(text, add_special_tokens=False).ids
    back = bpe.decode(ids, t)
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert {r.doc: r.text for r in back.collect()} == texts


def test_encoding_of_nulls_repeats_and_long_documents(spark, trained):
    df = spark.createDataFrame([(1, None), (1, "low low"), (None, "new"), (2, "lower " * 60_000), (3, "w" * 5000)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(df, trained), trained).collect()
    assert sorted((r.doc is None, r.doc or 0, r.text) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc long, tokens array<int>"), trained).collect()


def test_decoding_keeps_the_size_of_ids(spark, trained):
    """Ids of encode are not widened in the batches that go to Python; long ids decode as well."""
    ids = spark.createDataFrame([(0, [0, 1, 2]), (1, []), (2, None)], "doc int, tokens array<int>")
    plan = bpe.decode(ids, trained)._jdf.queryExecution().analyzed().toString()
    assert "bigint" not in plan
    wide = ids.withColumn("tokens", F.col("tokens").cast("array<long>"))
    assert sorted(bpe.decode(ids, trained).collect()) == sorted(bpe.decode(wide, trained).collect())


def test_reach_of_a_table(spark):
    """Merges count in the order of their ranks; a chain takes as many rounds as it is long."""
    chain = [(k, "a" * (k + 1), "a") for k in range(9)] + [(9, "z", "aaaa"), (10, "q", "zz"), (12, "x", "yw"), (13, "y", "w")]
    names = bytelevel.initial_alphabet() + ["a" * k for k in range(2, 11)] + ["zaaaa", "qzz", "xyw", "yw"]
    vocab = spark.createDataFrame(list(enumerate(names)), "id long, token string")
    merges = spark.createDataFrame(chain, "rank int, left string, right string")
    lost = {r.token for r in bpe.token_reach(vocab, merges).where("not reachable").collect()}
    assert lost == {"qzz", "xyw"}
    assert {r.token: r.since for r in bpe.reach_ranks(vocab, merges).where("since >= 0").collect()} == {**{"a" * (k + 2): k for k in range(9)}, "zaaaa": 9, "yw": 13}
    assert {r["rank"] for r in bpe.merge_reach(vocab, merges).where("not reachable").collect()} == {10, 12}
