import random

import pyarrow as pa
import pyarrow.compute
import pytest

from corpusmill.llm import exact_dedup, ngram_join, substring_dedup
from corpusmill.llm.common import gram_hashes, stored
from corpusmill.llm.components import components
from corpusmill.llm.packed import shared

from .brute import jaccard_components, substring

EXTRA = "doc_id long, text string, __keep int, component string, lang string"


def extra(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, "x", None) for d, t in rows], EXTRA)


def corpus(seed, n=120, vocab=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocab)}"
    passage = [word() for _ in range(70)]
    rows = []
    for d in range(n):
        kind = rng.random()
        if rows and kind < 0.45:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randrange(1, 150))]
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            cut = rng.randrange(0, 20)
            w = w[:at] + passage[cut : cut + rng.randrange(48, 60)] + w[at:]
        rows.append((d * 3, " ".join(w)))
    rng.shuffle(rows)
    return [*rows, (1, None), (2, ""), (4, " \t\n"), (5, "One two"), (7, "one TWO"), (8, "É x y z a b"), (10, "é x y z a b")]


@pytest.mark.parametrize("seed", [1])
def test_ngram_join_against_brute_force(spark, seed):
    rows = corpus(seed)
    # exactly at the threshold, 12 of 16 shingles: links
    rows += [(3_001, " ".join(f"a{k}" for k in range(18))), (3_002, " ".join([*(f"a{k}" for k in range(16)), "b1", "b2"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect()}
    assert got == jaccard_components(rows) and got[3_002][1] == 3_001


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = corpus(5, 60)
    kept = ngram_join.drop_near_duplicates(extra(spark, rows))
    assert kept.columns == ["doc_id", "text", "__keep", "component", "lang"]
    assert {r.doc_id for r in kept.collect()} == {c for _, c in jaccard_components(rows).values()}


def test_a_large_group_of_near_copies(spark):
    """A chain and a star in one: links between members that are no copies of the smallest one."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    for d in range(300, 330):
        base[(d * 7) % 60] = f"y{d}"
        rows.append((d, " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect()}
    assert got == jaccard_components(rows)


@pytest.mark.parametrize("seed", [3])
def test_substrings_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.parse(extra(spark, rows)).collect()}
    assert got == substring(rows)
    assert sum(x[1] for x in got.values()) > 0


def test_factors_lie_in_their_sources(spark):
    rows = corpus(6)
    words = {d: (t or "").split() for d, t in rows}
    for r in substring_dedup.parse(extra(spark, rows)).collect():
        for f in r.factors:
            assert f.src < r.doc_id and f.words >= 50
            assert words[r.doc_id][f.start : f.start + f.words] == words[f.src][f.src_start : f.src_start + f.words]


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"w{k % 55}" for k in range(200))
    df = extra(spark, [(5, text), (5, text), (None, text), (6, "x " + text), (None, None)])
    rows = substring_dedup.parse(df).collect()
    assert len(rows) == 5 and {r.n_removed for r in rows if r.doc_id in (5, 6)} == {200}
    j = ngram_join.jaccard_groups(df).collect()
    assert len(j) == 5 and len({r.component_id for r in j if r.doc_id is not None}) == 1
    for f in (substring_dedup.parse, ngram_join.jaccard_groups, exact_dedup.exact_groups):
        assert f(df.limit(0)).count() == 0
    e = exact_dedup.exact_groups(df).collect()
    assert sorted((r.group_size, r.kept) for r in e if r.doc_id == 5) == [(3, True), (3, True)]
    assert len(e) == 5


LOW = -(2**63)


def test_null_and_extreme_ids(spark):
    """A null id names nothing; the smallest number is an id like others."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (5, text), (7, text), (LOW, "other " * 60), (2**63 - 1, "other " * 60), (None, None), (None, "alone at last")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 56, None), (5, 56, 5), (7, 56, 5), (LOW, 1, LOW), (2**63 - 1, 1, LOW), (None, 0, None), (None, 1, None)], key=str)
    kept = ngram_join.drop_near_duplicates(extra(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([None, None, None, 5, LOW], key=str)
    parsed = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.parse(extra(spark, rows)).collect()), key=str)
    assert parsed == sorted([(None, 60, 0), (5, 60, 60), (7, 60, 60), (LOW, 60, 0), (2**63 - 1, 60, 60), (None, 0, 0), (None, 3, 0)], key=str)
    exact = {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(extra(spark, rows)).collect()}
    assert {(5, 5), (7, 5), (None, 5), (LOW, LOW), (2**63 - 1, LOW)} <= exact


def test_an_id_with_two_texts(spark):
    """For links the texts of an id are one set; sizes are those of each text."""
    one, two = [" ".join(f"{c}{k}" for k in range(44)) for c in "ab"]
    rows = [(9, one), (9, two), (9, two), (3, one + " " + two), (4, one)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect())
    assert got == [(3, 84, 3), (4, 40, 4), (9, 40, 3), (9, 40, 3), (9, 40, 3)]


def test_one_passage_in_every_document(spark, monkeypatch):
    """A posting of all documents, dealt to blocks of a few, and near copies in different components."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(21)
    words = [f"v{k}" for k in range(40)]
    common = " ".join(f"s{k}" for k in range(60))
    rows = []
    for d in range(150):
        own = " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))
        rows.append((d, f"{own} {common} {own}" if d % 3 else f"{common} {own}"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect()}
    assert got == jaccard_components(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.parse(extra(spark, rows)).collect()} == substring(rows)


def test_connected_documents_are_not_paired(spark, monkeypatch):
    """A group of which most pairs link, and none is a copy of a hub: stars connect it, and the rest is empty."""
    rng = random.Random(1)
    pool = [[f"p{j}x{i}" for i in range(9)] for j in range(40)]
    common = [f"c{k}" for k in range(84)]
    rows = [(d, " ".join([*common, *(w for j in rng.sample(range(40), 2) for w in pool[j]), f"u{d}"])) for d in range(300)]
    seen = {}

    def noted(df, label, *rest):
        out = stored(df, label, *rest)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", noted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect()}
    assert got == jaccard_components(rows) and len({c for _, c in got.values()}) == 1
    assert seen["ngram-rest"] == 0 and seen["ngram-stars"] < 300 * 10


def test_what_all_documents_share_is_one_entry_of_a_bucket():
    """What a bucket sends to a fragment does not grow with the copies in it."""

    def table(n):
        text = " ".join(f"w{k}" for k in range(300))
        return pa.table({"doc_id": pa.array(range(n)), "text": pa.array([text] * n), "bucket": pa.array([3] * n, pa.int32()), "h": pa.array([7] * n, pa.int64())})

    def entries(t, column, kind):
        return sum(len(x.as_py()) // kind for x in t.column(column))

    small, large = (ngram_join._counts(5, 4)(table(n)) for n in (20, 80))
    assert entries(small, "keys", 4) == entries(large, "keys", 4) == 296
    small, large = (substring_dedup._anchor_counts(50, 4)(table(n)) for n in (20, 80))
    assert entries(small, "keys", 4) == entries(large, "keys", 4)
    windows = [substring_dedup._window_cells(50, 4)(table(n), pa.concat_tables([shared(x) for x in by_part(large)])) for n in (20, 80)]
    assert [entries(w, "hashes", 8) for w in windows] == [251, 251]


def by_part(t):
    return [t.filter(pa.compute.equal(t.column("part"), p)) for p in sorted(set(t.column("part").to_pylist()))]


def test_very_long_texts(spark):
    """Texts of more than a slice of work, one a copy of the other with a change."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    changed = [*words[:100_000], "changed", *words[100_001:]]
    rows = [(2, " ".join(words)), (1, " ".join(changed)), (8, " ".join(words[:50])), (9, " ".join(words) + " ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(extra(spark, rows)).collect()}
    assert got == jaccard_components(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.parse(extra(spark, rows)).collect()} == substring(rows)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(extra(spark, rows)).collect()} == {(1, 1), (2, 9), (9, 9), (8, 8)}


def test_exact_groups(spark):
    rows = [(7, "a b"), (3, "ab"), (9, "a  b"), (4, "a\nb "), (2, None), (1, ""), (6, " \t"), (8, "A b"), (10, "a b"), (11, "😀"), (12, "a b")]
    df = extra(spark, rows)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got[9] == (4, 6, False) and got[4] == (4, 6, True) and got[3][0] == 4 and got[10] == (4, 6, False)
    assert got[6] == (6, 3, True) and got[1] == (6, 3, False) and got[8] == (8, 1, True) and got[11] == (11, 1, True)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 6, 8, 11}


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat an id: equal ones, longer and shorter ones, and one whose id stays for another text."""
    df = extra(spark, [(5, "a b"), (5, "a b"), (5, "ab"), (1, "c  d"), (2, "cd"), (2, "e"), (None, "f"), (None, "f"), (None, None), (9, "")])
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "a b"), (1, "c  d"), (2, "e"), (None, "f"), (9, "")], key=str)
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_and_short_gram_hashes_depend_on_their_words_only():
    import numpy as np

    w = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in (5, 25, 50):
        assert (gram_hashes(w, k)[7:] == gram_hashes(w[7:], k)).all()
        assert len(set(gram_hashes(w, k).tolist())) == len(w) - k + 1


def test_exact_groups_hash_and_hot_groups_meet_where_they_are(spark, monkeypatch):
    """Groups above and below the bound, ties in length, ids that repeat, a null id and ids at the ends of their range."""
    rng = random.Random(31)
    rows = [(k, "hot text" + " " * rng.randrange(3)) for k in range(40)] + [(k + 100, f"t{k % 9}") for k in range(30)] + [(k + 200, f"only {k}") for k in range(9)]
    rows += [(3, "hot text  "), (3, "hot text  "), (None, "hot text   "), (LOW, "low"), (2**63 - 1, "l ow"), (None, None), (7, " "), (8, "")]
    df = extra(spark, rows)
    plan = exact_dedup.copied_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    groups = {}
    for d, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in exact_dedup.IGNORED), []).append((-len(t or ""), d is None, d or 0, d))
    want = []
    for _, members in groups.items():
        keep = min(members)[3]
        want += [(d, keep, len(members), d == keep) for *_, d in members]
    for hot in (4096, 9, 3, 1):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- factors


@pytest.mark.parametrize("grow", [0, 200])
def test_factors_are_parsed_greedily_and_cover_all_windows(spark, grow):
    """Factors follow each other as the parse says, their words are equal, and no factor could go on along its source."""
    rng = random.Random(77 + grow)
    rows = corpus(11, 90)
    # a document of pieces of many others, seams in the middle of passages, and one that goes on where its source's copy ends
    pieces = [t.split(" ") for _, t in rows if t and len(t.split(" ")) > 90]
    mosaic = [w for p in pieces[:8] for w in p[5 : 5 + rng.randrange(52, 80)]]
    rows += [(9001, " ".join(mosaic)), (9002, " ".join(mosaic[3:])), (9003, " ".join(["new"] * 60 + mosaic + ["end"] * 60)), (9004, " ".join(mosaic[:200] * 3))]
    words = {d: (t or "").split() for d, t in rows}
    want, seen = substring(rows), 0
    for r in substring_dedup.parse(extra(spark, rows), grow=grow).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        own, covered, least = words[r.doc_id], set(), 0
        for f in r.factors:
            src, end = words[f.src], f.start + f.words
            assert f.src < r.doc_id and f.words >= 50 and f.start >= least
            assert own[f.start : end] == src[f.src_start : f.src_start + f.words]
            if grow and end < len(own) and f.src_start + f.words < len(src):
                assert own[end] != src[f.src_start + f.words]
            least = end - 49  # the next one begins with a window that this one does not hold
            covered.update(range(f.start, end))
            seen += 1
        assert len(covered) == r.n_removed
    assert seen > 40


def test_greedy_takes_the_longest_and_checks_the_seams():
    runs = [(0, 60, 1, 0), (5, 100, 2, 5), (20, 90, 3, 0), (80, 140, 4, 0), (95, 150, 1, 7), (300, 350, 5, 0)]
    got = substring_dedup.greedy(runs, 50)
    assert got == [(0, 60, 1, 0), (11, 100, 2, 11), (80, 140, 4, 0), (95, 150, 1, 7), (300, 350, 5, 0)]
    assert substring_dedup.greedy([], 50) == []
    rng = random.Random(4)
    for _ in range(200):
        runs = [(a, a + rng.randrange(5, 30), rng.randrange(4), 0) for a in (rng.randrange(100) for _ in range(rng.randrange(9)))]
        parsed = substring_dedup.greedy(runs, 5)
        assert {k for a, b, *_ in parsed for k in range(a, b)} == {k for a, b, *_ in runs for k in range(a, b)}
        assert all(y[0] > x[1] - 5 for x, y in zip(parsed, parsed[1:], strict=False))


def test_words_of_one_hash_are_told_apart(spark):
    """Equal hashes decide nothing: the bytes of the words do."""
    import numpy as np

    own, other = [f"w{k}" for k in range(70)], [f"w{k}" for k in range(70)]
    other[60] = "zz"
    flat, at = substring_dedup.flat_words(*_spelt(own))
    table = pa.table({"src": [np.array([3]).tobytes()], "src_text": [np.array([9], np.uint64).tobytes()], "low": [np.array([0]).tobytes()], "sizes": [np.array([len(" ".join(other)) + 1]).tobytes()], "words": [(" ".join(other) + " ").encode()]})
    sources = substring_dedup.Sources(table)
    sources.hashes = np.zeros(70, np.uint64)
    found = substring_dedup._compared(50, 50, 70, flat, at, np.zeros(70, np.uint64), sources, (0, 70, 3, 9, 0))
    assert found == [(0, 60, 3, 0)]


def _spelt(words):
    import numpy as np

    from corpusmill.llm.common import word_spans

    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return data, starts, ends


def test_ranges_of_one_source_are_asked_for_once():
    import numpy as np

    src, text = np.array([1, 1, 1, 2, 1]), np.array([5, 5, 5, 5, 6], np.uint64)
    got = substring_dedup.merged_ranges(src, text, np.array([0, 30, 100, 0, 0]), np.array([40, 60, 120, 9, 9]))
    assert [x.tolist() for x in got] == [[1, 1, 1, 2], [5, 5, 6, 5], [0, 100, 0, 0], [60, 120, 9, 9]]
