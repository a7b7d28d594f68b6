import hashlib
import re
import struct
import zlib

import duckdb
import pytest

from corpusmill.llm import media, mixing
from corpusmill.llm.common import stored
from corpusmill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, ([r[c] for c in names] for r in df.collect()))) == sorted(map(str, map(list, cur.fetchall())))


def plain_boxes(raw, start, end, found):
    """{path: [body]} of a file, one box at a time."""
    while start < end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        found.setdefault(kind, []).append(raw[start + 8 : start + size])
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            plain_boxes(raw, start + 8, start + size, found)
        start += size
    return found


def test_media_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    files = {r.doc_id: bytes(r.media) for r in media.to_media(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rows = QUERIES["op10_media"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        f = files[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
        # samples, keyframes and duration by a reader that goes sample by sample
        b = {k: v[0] for k, v in plain_boxes(f, 0, len(f), {}).items()}
        size, n = struct.unpack_from(">II", b[b"stsz"], 4)
        runs = [struct.unpack_from(">III", b[b"stsc"], 8 + 12 * k) for k in range(struct.unpack_from(">I", b[b"stsc"], 4)[0])]
        starts = []
        for chunk in range(1, struct.unpack_from(">I", b[b"stco"], 4)[0] + 1):
            at = struct.unpack_from(">I", b[b"stco"], 4 + 4 * chunk)[0]
            starts += [at + size * k for k in range([m for first, m, _ in runs if first <= chunk][-1])]
        keys = [struct.unpack_from(">I", b[b"stss"], 8 + 4 * k)[0] - 1 for k in range(struct.unpack_from(">I", b[b"stss"], 4)[0])]
        assert b"".join(f[a : a + size] for a in starts) == full == b[b"mdat"] and len(starts) == n
        rate, ticks = struct.unpack_from(">IQ", b[b"mdhd"], 20)
        spans = [(starts[k], starts[k] + size) for k in keys]
        assert r.feature == f"raw;{ticks}/{rate};samples={n};keys={len(keys)};first={spans[0][0]}-{spans[0][1]};last={spans[-1][0]}-{spans[-1][1]}" and ticks == len(full)


@pytest.mark.parametrize(("name", "label", "limit"), [("op3_toxicity", "toxic", 0.5), ("op6_quality", "quality", 0.3)])
def test_classifier_queries_on_held_out_rows(spark, name, label, limit):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= limit) and 0 <= r.score <= 1 for d, r in rows.items())
    known = [(rows[r.doc_id], r[label]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    known = [(r, y) for r, y in known if r.held_out]
    assert sum(r.predicted == y for r, y in known) / len(known) > 0.9


def test_chat_query_on_tied_repeated_and_null_turns(spark, tmp_path):
    rows = [
        (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 1, "user", "c"),  # a user and an assistant in one turn
        (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"),  # repeated rows
        (3, None, "assistant", "end"), (3, 0, "user", "first"),
        (4, None, "assistant", "q"), (4, None, "user", "p"), (4, None, None, None), (4, 5, "user", "o"),
        (None, 0, "user", "n"), (None, 0, "user", "n"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(SQL["op8_chat"])
    names = [d[0] for d in cur.description]
    want = {r["conv_id"]: r for r in (dict(zip(names, x, strict=True)) for x in cur.fetchall())}
    got = {r.conv_id: r.asDict() for r in QUERIES["op8_chat"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) == {-1, 1, 2, 3, 4, None}
    for c in got:
        # SQL leaves the order of different rows of one turn open
        for name in names if c not in (1, 4) else ("n_turns", "loss_chars", "loss_sha256", "formatted_chars"):
            assert got[c][name] == want[c][name], (c, name)
    told = {1: "assistant\nb\nuser\na\nuser\nc\n", 4: "user\no\n\n\nassistant\nq\nuser\np\n"}
    assert all(got[c]["turns_sha256"] == hashlib.sha256(t.encode()).hexdigest() for c, t in told.items())


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op7_mixing", "op8_chat"])
def test_native_queries_have_no_python(spark, name, monkeypatch):
    """Neither the result's plan nor those of the tables it is made from."""
    plans = []

    def noted(df, label, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label, *rest)

    monkeypatch.setattr(mixing, "stored", noted)
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == (4 if name == "op7_mixing" else 1)
    assert not [p for p in plans if re.search("Python|Arrow|Pandas", p)]
