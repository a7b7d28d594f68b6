import hashlib
import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import bpe
from corpusmill.llm.common import text_buffers
from corpusmill.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pair():
    path = tokenizer_path()
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return bpe.tokenizer(spec), Tokenizer.from_file(path)


ALPHABET = list(" \t\r\n\x0b\x1c\x1f\x85\xa0 　​'abstrevmldZÉñ09٣Ⅷ½😀́中<|>.!") + ["'s", "'re", "'ll", "'ve", "'t", " 's", "  ", "<|endoftext|>", "aaaa", "\n\n"]


def ids_of(t, texts):
    data, offs = text_buffers(pa.array(texts, pa.string()))
    flat, at = t.encode(data, offs)
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], t.decode(flat, at)


def test_same_ids_as_the_library(pair):
    mine, theirs = pair
    rng = random.Random(5)
    texts = ["", " ", "'s", "x's", "''s", "a" * 3000, "<|endoftext|>", "<|endoftext|><|endoftext|>x", "İstanbul"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    got, back = ids_of(mine, texts)
    for text, ids, raw, want in zip(texts, got, back, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids, repr(text)
        assert raw.decode() == theirs.decode(want.ids, skip_special_tokens=False) == text


def test_small_cache_gives_the_same(pair, monkeypatch):
    mine, theirs = pair
    monkeypatch.setattr(bpe, "CACHE", 5)
    texts = ["one two three four five six seven eight", "nine ten <|endoftext|> one"]
    mine.clear()
    assert ids_of(mine, texts)[0] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    mine.clear()


def test_long_pieces(pair):
    """Pieces that are merged on their own have the library's ids, in n log n."""
    mine, theirs = pair
    rng = random.Random(8)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("ab", 3000), ("abcdefghijklmnopqrstuvwxyz", 5000), ("etaoin", 2000), ("x", 4097), ("xX", 1500), ("éñü", 900), ("-=", 5000), ("0123456789", 2000))]
    texts += [f"short {t} words" for t in texts] + [" " * 3000, "\n" * 700 + "a", "a" * bpe.LONG, "a" * (bpe.LONG + 1)]
    got, back = ids_of(mine, texts)
    for text, ids, raw, want in zip(texts, got, back, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids, text[:30]
        assert raw.decode() == text
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1 << 20))
    began = time.perf_counter()
    (ids,), (raw,) = ids_of(mine, [long])
    assert raw.decode() == long and time.perf_counter() - began < 60
    assert ids == theirs.encode(long, add_special_tokens=False).ids


def test_invalid_utf8(spark, pair):
    """Bytes that are no UTF-8 are U+FFFD, one for each byte; the other texts of a slice are as they were."""
    mine, theirs = pair
    rows = [(1, bytearray(b"ok one")), (2, bytearray(b"a\xffb\xe4\xb8")), (3, bytearray(b"\xed\xa0\x80")), (4, bytearray("é two".encode()))]
    df = spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = {r.doc_id: r for r in bpe.round_trip(df, tokenizer_path()).collect()}
    for d, text in ((1, "ok one"), (2, "a\ufffdb\ufffd\ufffd"), (3, "\ufffd" * 3), (4, "é two")):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_shape_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "héllo <|endoftext|>", "z"), (3, "héllo <|endoftext|>", "z"), (None, "a", "w")], "doc_id long, text string, ids string")
    rows = bpe.round_trip(df, tokenizer_path()).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by[1].n_tokens == 0 and by[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    want = Tokenizer.from_file(tokenizer_path()).encode("héllo <|endoftext|>", add_special_tokens=False).ids
    assert by[3].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert by[3].decoded_sha256 == hashlib.sha256("héllo <|endoftext|>".encode()).hexdigest()
    assert None in by
    assert bpe.round_trip(df.limit(0), tokenizer_path()).count() == 0
    assert json.loads(json.dumps(bpe.encode_texts(df, tokenizer_path()).where("doc_id = 1").first().ids)) == []
