import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import chat, media, mixing
from corpusmill.llm.queries import QUERIES, conversation_events

# ---------------------------------------------------------------- media


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 16, 576 * 16 + 1, 576 * 50])
def test_mux_and_probe(size):
    raw = media.pad(bytes(k % 251 for k in range(size)))
    assert len(raw) % 576 == 0 and len(raw) > 0
    f = media.mux(raw)
    (t,) = media.probe(f)
    assert media.stored_bytes(f, t) == raw and t.codec == "raw " and t.duration == len(raw) and t.timescale == 8000
    assert len(t.keys) == -(-len(t.sizes) // media.KEY_EVERY)
    for a, b in t.ranges(t.keys):
        assert (b - a) % 576 == 0 and f[a:b] in raw


def test_other_layouts():
    """Sizes per sample, 64-bit offsets and box sizes, a box to the end, version 0, no sync table."""
    parts = [b"abc", b"de", b"", b"fghij"]
    body = b"".join(parts)
    full = media.full

    def moov(base):
        stbl = media.box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), full(b"stts", struct.pack(">III", 1, 4, 1)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)),
            full(b"stsz", struct.pack(">II4I", 0, 4, *map(len, parts))), full(b"co64", struct.pack(">IQQ", 2, base, base + 5 + 3)),
        )
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 600, 1200, 0, 0)), media.box(b"minf", stbl))))

    wide = lambda kind, x: struct.pack(">I4sQ", 1, kind, len(x) + 16) + x
    head = wide(b"free", b"..")
    m = len(moov(0))
    base = len(head) + m + 8
    f = head + moov(base) + struct.pack(">I4s", 0, b"mdat") + body[:5] + b"gap" + body[5:]
    (t,) = media.probe(f)
    assert media.stored_bytes(f, t) == body and (t.codec, t.timescale, t.duration) == ("mp4a", 600, 1200) and t.keys.tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="does not fit"):
        media.probe(f[: len(head) + 20])


def test_media_columns(spark):
    text = "héllo " * 5000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, text, "x"), (4, text, "y"), (None, "a", "z")], "doc_id long, text string, media string")
    m = media.to_media(df)
    rows = {r.doc_id: r for r in media.digests(m).collect()}
    raw = media.pad(text.encode())
    r = rows[3]
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
    assert r.media_sha256 == rows[4].media_sha256 and r.feature == rows[4].feature and rows[1].media_sha256 == rows[2].media_sha256
    assert rows[1].n_bytes == 0 and rows[1].payload_bytes == 576 and None in rows
    assert media.digests(media.to_media(df.limit(0))).count() == 0
    assert len(m.where("doc_id = 3").first().keyframes) > 3


# ---------------------------------------------------------------- chat

EVENTS = "conv long, seq long, msg long, kind string, role string, text string"


def unescape(s):
    return re.sub(r"(?s)\\(.)", r"\1", s)


def test_events_are_folded(spark):
    rows = [
        (1, 1, 10, "delta", "user", "Hel"), (1, 2, 10, "delta", None, "lo"), (1, 3, 11, "delta", "assistant", "bad"), (1, 6, 11, "delta", None, " answer"),
        (1, 5, 11, "regenerate", None, "good"), (1, 7, 10, "edit", None, "Hi"), (1, 8, 10, None, None, "!"), (2, 1, 1, "delta", None, None), (None, None, 1, "delta", "user", "null"),
    ]
    m = chat.fold_events(spark.createDataFrame(rows, EVENTS))
    got = {(r.conv, r.msg): (r.role, r.text, r["at"]) for r in m.collect()}
    assert got == {(1, 10): ("user", "Hi!", 1), (1, 11): ("assistant", "good answer", 3), (2, 1): ("", "", 1), (None, 1): ("user", "null", None)}
    assert chat.fold_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_rows_as_events_meet_every_kind(spark):
    rows = [(1, 0, "user", "héllo"), (1, 1, "assistant", "x" * 100_001), (1, 1, "assistant", "y"), (1, 2, None, None)]
    log = conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"delta", "edit", "regenerate"} and log.count() == 12
    got = {(r.role, r.text) for r in chat.fold_events(log).collect()}
    assert got == {(role or "", text or "") for _, _, role, text in rows}


def test_round_trip_of_hostile_texts(spark):
    texts = ["", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\\\<|", "<\\|im_end|>", "<", "a<", "\n", "\\n", "😀<|im_start|>", "<|", "|>", "$1 \\$", "\\|"]
    roles = ["user", "assistant", "a\nb", "\\n", "<|im_end|>", "", "\\\nx", "\\\\n"]
    rows = [(c, k, k, "delta", roles[(c + k) % len(roles)], t) for c in range(8) for k, t in enumerate(texts)]
    r = chat.render(chat.fold_events(spark.createDataFrame(rows, EVENTS)))
    want = {c: [(roles[(c + k) % len(roles)], t) for k, t in enumerate(texts)] for c in range(8)}
    for row in r.select("*", chat.read_back(F.col("formatted")).alias("turns")).collect():
        turns = want[row.conv]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.formatted.count("<|im_end|>") == len(turns) == row.formatted.count("<|im_start|>")
        learnt = [t for role, t in turns if role == "assistant"]
        assert [unescape(row.formatted[s.start : s.start + s.length]) for s in row.loss_spans] == learnt
        assert [t for (_, t), on in zip(turns, row.loss_turns, strict=True) if on] == learnt
    for d in chat.digest(r).collect():
        told = "".join(f"{role}\n{t}\n" for role, t in want[d.conv_id])
        learnt = "".join(t for role, t in want[d.conv_id] if role == "assistant")
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256) == (len(texts), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_has_no_python(spark):
    e = spark.createDataFrame([(1, 1, 1, "delta", "user", "x")], EVENTS)
    plan = chat.digest(chat.render(chat.fold_events(e)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ExistingRDD", ""))


# ---------------------------------------------------------------- mixing


def mixed(spark):
    rows = []
    for k in range(300):
        lang = "en" if k % 3 else "de"
        words = ["the", "of", "and"] if lang == "en" else ["der", "und", "von"]
        rows.append((k, " ".join(words[(k + i) % 3] for i in range(5 + k % 40)), lang, 7))
    return spark.createDataFrame([*rows, (300, None, "en", 7), (301, "", None, 7), (302, "und the", None, 7), (None, "the", "en", 7)], "doc_id long, text string, lang string, tokens int")


def test_targets_are_met_in_expectation(spark):
    df = mixed(spark)
    found, fit = mixing.mix(df, "lang", {"de": 5000, "en": 2500})
    rows = found.collect()
    assert fit.domains == ["de", "en"]
    for k, want in enumerate((5000, 2500)):
        assert sum(r.rate * r.tokens * r.p[k] for r in rows) == pytest.approx(want, rel=1e-3)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) and sum(r.p) == pytest.approx(1) for r in rows)


def plain_posteriors(rows):
    """Naive Bayes in plain Python: {(id, text): (tokens, p)} of (id, text, domain) rows with words."""
    words = {t: [xxhash.xxh64(w.lower().encode(), seed=42).intdigest() % mixing.BUCKETS for w in t.split()] for _, t, _ in rows if t}
    domains = sorted({d for _, _, d in rows if d is not None})
    n = {d: sum(1 for r in rows if r[2] == d) for d in domains}
    count = {d: np.zeros(mixing.BUCKETS) for d in domains}
    for _, t, d in rows:
        for b in words.get(t, []) if d is not None else []:
            count[d][b] += 1
    seen = sum(count.values()) > 0
    ll = {d: np.where(seen, np.log((count[d] + 0.5) / (count[d].sum() + 0.5 * mixing.BUCKETS)), 0.0) for d in domains}
    out = {}
    for i, t, _ in rows:
        if words.get(t):
            m = len(words[t])
            z = np.array([np.log(n[d] / sum(n.values())) + mixing.EVIDENCE / (mixing.EVIDENCE + m) * ll[d][words[t]].sum() for d in domains])
            e = np.exp(z - z.max())
            out[i, t] = (m, (e / e.sum()).tolist())
    return out


def plain_rates(tokens, p, targets, least, rounds=100_000):
    """Projected gradient of the plain least squares, with a fixed short step and nothing else."""
    a = (p * tokens[:, None]).T
    r = np.maximum(np.ones(len(tokens)), least)
    scale = 1 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p).max()
    for _ in range(rounds):
        r = np.maximum(least, r + scale * (p @ (targets - a @ r)))
    return a @ r


def overlapping(spark):
    """Documents of three languages that share words; one id has two texts, and one row repeats."""
    rng = random.Random(4)
    own = {"a": ["ax", "ay", "az"], "b": ["bx", "by"], "c": ["cx", "cy", "cz", "cw"]}
    rows = []
    for k in range(240):
        d = rng.choice("aaabbc")
        rows.append((k, " ".join(rng.choice(own[d] if rng.random() < 0.3 else ["s", "t", "u", rng.choice(own[rng.choice("abc")])]) for _ in range(rng.randrange(1, 60))), d if k % 7 else None))
    rows += [(5, " ax  ay\tbx ", "a"), (6, rows[6][1], rows[6][2]), (500, "\n", "b"), (501, None, "c"), (None, "cx cy", "c")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, h int")


def test_posteriors_and_tokens_against_plain_python(spark):
    rows, df = overlapping(spark)
    want = plain_posteriors(rows)
    domains, priors, table = mixing.classifier(df, "lang")
    text_of = {(i, t): h for i, t, h in ((r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).where("text is not null").collect())}
    got = {(r.doc, r.h): r for r in mixing.posteriors(df, domains, priors, table).collect()}
    assert set(got) == {(i, text_of[i, t]) for i, t in want}
    for (i, t), (m, p) in want.items():
        r = got[i, text_of[i, t]]
        assert r.tokens == m and r.p == pytest.approx(p) and r.rows == sum(1 for x in rows if x[:2] == (i, t))
    out = mixing.document_rates(df, "lang").collect()
    assert len(out) == len(rows)
    assert sorted(r.n_tokens for r in out if r.doc_id in (5, 6)) == sorted(len(t.split()) for i, t, _ in rows if i in (5, 6))


@pytest.mark.parametrize(("targets", "least", "met"), [([4000, 2500, 1500], 0, True), ([300, 3000, 900], 0, True), ([0, 4000, 100], 0, False), ([3000, 0, 0], 0, False), ([9000, 5000, 4000], 1, True), ([100, 9000, 100], 1, False)])
def test_fit_against_plain_projected_gradient(spark, targets, least, met):
    """The totals are as near as those of a plain projected gradient in numpy where bounds bite; where targets can't
    be met the fit says so, and is as near as an early end leaves it."""
    rows, df = overlapping(spark)
    want = plain_posteriors(rows)
    every = [want[r[:2]] for r in rows if r[:2] in want]
    tokens, p = np.array([m for m, _ in every], float), np.array([x for _, x in every])
    found, fit = mixing.mix(df, "lang", dict(zip("abc", targets, strict=True)), least=least)
    best = plain_rates(tokens, p, np.array(targets, float), least)
    off = lambda x: np.linalg.norm(np.array(x) - targets)
    assert fit.met == met and off(fit.totals) <= (off(best) + 1e-3 * sum(targets) if met else 2 * off(best) + 1e-2 * sum(targets))
    got = found.collect()
    assert all(r.rate >= least for r in got)
    assert [sum(r.rate * r.tokens * r.rows * r.p[k] for r in got) for k in range(3)] == pytest.approx(fit.totals)


def test_default_targets_shrink_nothing(spark):
    df = mixed(spark)
    rows = {r.doc_id: r for r in mixing.document_rates(df, "lang").collect()}
    assert len(rows) == 304 and rows[300].copies == 1 and rows[301].n_tokens == 0
    out = mixing.mixed_documents(df, "lang", least=1.0)
    assert out.columns == df.columns
    copies = {}
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) == set(rows) and sum(copies.values()) > 304


def test_mixing_edges(spark):
    df = mixed(spark)
    assert mixing.document_rates(df.limit(0), "lang").count() == 0
    alone = mixing.document_rates(df.withColumn("lang", F.lit(None).cast("string")), "lang").collect()
    assert len(alone) == 304 and {r.rate for r in alone} == {1.0}


def test_all_domains_have_a_posterior_and_a_target(spark):
    """70 domains, of 3 documents each."""
    rows = [(k, " ".join(f"w{k // 3}x{i}" for i in range(20)) + " the", f"d{k // 3:02}") for k in range(210)]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string")
    found, fit = mixing.mix(df, "site", {f"d{k:02}": 63.0 + k for k in range(70)})
    assert fit.domains == [f"d{k:02}" for k in range(70)]
    rows = found.collect()
    for k in range(70):
        assert sum(r.rate * r.tokens * r.p[k] for r in rows) == pytest.approx(63 + k, rel=1e-2)
        assert all(r.p[k] > 0.9 for r in rows if r.doc // 3 == k)


def test_rare_domain_and_unknown_target(spark):
    rows = [(k, "the of and" if k % 3000 else "der und von", "en" if k % 3000 else "de") for k in range(1, 9001)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    domains, priors, _ = mixing.classifier(df, "lang")
    assert domains == ["de", "en"] and priors == pytest.approx([np.log(3 / 9000), np.log(8997 / 9000)])
    with pytest.raises(ValueError, match="fr"):
        mixing.mix(mixed(spark), "lang", {"de": 10, "fr": 10})


@pytest.mark.parametrize("targets", [None, {"de": 6000, "en": 100}])
def test_sums_by_rows_equal_sums_by_columns(spark, monkeypatch, targets):
    df = mixed(spark).where("doc_id is not null")
    flat, a = mixing.mix(df, "lang", targets)
    want = {r.doc: (r.tokens, r.rate, *r.p) for r in flat.collect()}
    monkeypatch.setattr(mixing, "FLAT", 0)
    found, b = mixing.mix(df, "lang", targets)
    got = {r.doc: (r.tokens, r.rate, *r.p) for r in found.collect()}
    assert b.totals == pytest.approx(a.totals) and set(got) == set(want) and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def test_a_conversation_of_very_many_turns(spark):
    """Linear in turns: the text under the spans, read turn by turn."""
    import time

    n = 12_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('é<|im_end|>\\\\ ', id) AS text")
    began = time.time()
    got = chat.digest(chat.render(chat.fold_events(conversation_events(rows)))).first()
    took = time.time() - began
    texts = [f"é<|im_end|>\\ {k}" for k in range(n)]
    loss = "".join(texts[1::2])
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    told = "".join(f"{'assistant' if k % 2 else 'user'}\n{t}\n" for k, t in enumerate(texts))
    assert got.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and took < 60


def test_query_holds_rates_at_the_bound(spark):
    """The query's targets shrink a language to almost nothing: as near to them as a plain projected gradient comes, many rates 0."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    domains, priors, table = mixing.classifier(df, "lang")
    post = mixing.posteriors(df, domains, priors, table).collect()
    tokens, p = np.array([r.tokens * r.rows for r in post], float), np.array([list(r.p) for r in post])
    targets = np.array(mixing.thinned()((tokens @ p).tolist()))
    best = plain_rates(tokens, p, targets, 0.0)
    rows = QUERIES["op7_mixing"](spark, "/root/testdata/sf0.01").collect()
    rate = {r.doc_id: r.rate for r in rows}
    totals = sum(np.array([rate[r.doc] * r.tokens * x for x in r.p]) for r in post)
    off = [np.linalg.norm(np.array(t) - targets) for t in (totals, best)]
    assert off[0] <= off[1] + 2e-4 * targets.sum()
    zero = sum(r.rate == 0 for r in rows)
    assert zero > 20 and all(r.rate >= 0 for r in rows) and min(targets) == pytest.approx(0.001 * targets.sum())


def test_rates_written_between_steps_change_nothing(spark, monkeypatch):
    _, df = overlapping(spark)
    found = []
    for store in (1, 2, 100):
        monkeypatch.setattr(mixing, "STORE", store)
        rates, fitted = mixing.mix(df, "lang", {"a": 300, "b": 3000, "c": 900})
        found.append((fitted.met, {(r.doc, r.h): r.rate for r in rates.collect()}))
        assert len(fitted.steps) > 2
    for met, rate in found:
        assert met == found[2][0] and all(rate[k] == pytest.approx(v, abs=1e-6) for k, v in found[2][1].items())


def test_targets_that_cannot_be_met_are_told(spark):
    with pytest.warns(UserWarning, match="not what was asked for"):
        mixing.mixed_documents(mixed(spark), "lang", {"de": 100, "en": 9000}, least=1.0)
