import hashlib
import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import vector_codes, whitening
from corpusmill.llm.common import new_path
from corpusmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


# ---------------------------------------------------------------- block Lanczos


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("block", [1, 3, 4, 16, 40])
@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 40, 40),
        2.0 ** -np.arange(40.0),
        np.repeat([9.0, 5.0, 1.0, 0.0], 10),  # equal eigenvalues: blocks break down and start again
        np.concatenate([[1e6], np.ones(39)]),
        np.zeros(40),
    ],
)
def test_lanczos_finds_the_leading_eigenpairs(values, block):
    v, calls = symmetric(values), []

    def multiply(q):
        calls.append(q.shape[1])
        return v @ q

    e, u = whitening.block_lanczos(multiply, 40, 6, block)
    assert np.allclose(e, np.sort(values)[::-1][:6], rtol=1e-12, atol=1e-12 * max(values.max(), 1))
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-13
    assert np.abs(v @ u - u * e).max() <= 1e-11 * max(values.max(), 1)
    assert sum(calls) <= 40


def test_lanczos_ends_before_the_whole_space():
    values = np.concatenate([[100.0, 90, 80, 70], np.linspace(0, 1, 396)])
    v, calls = symmetric(values), []
    e, u = whitening.block_lanczos(lambda q: calls.append(q.shape[1]) or v @ q, 400, 4, 4)
    assert sum(calls) < 120
    exact, w = np.linalg.eigh(v)
    assert np.abs(np.abs(np.sum(u * w[:, ::-1][:, :4], axis=0)) - 1).max() < 1e-12 and np.allclose(e, exact[::-1][:4])


def plain_whitening(rows, k=16):
    """{vec_id: ...} from the covariance matrix itself."""
    keep = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in keep})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, sums, e, u, np.trace(v), keep


def test_whitening_query_equals_the_covariance_matrix(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, sums, e, u, trace, keep = plain_whitening(rows)
    got = defaultdict(dict)
    for r in QUERIES["op12_whitening"](spark, SF).collect():
        got[r.vec_id][r.component] = r
    assert sorted(got) == sorted(i for i, _ in keep)
    signs = None
    for i, x in keep:
        y = [n * a - s for a, s in zip(x, sums, strict=True)]
        assert {r.deviation for r in got[i].values()} == {sum(b * b for b in y)} and sorted(got[i]) == list(range(1, 17))
        want = np.array(y) / n @ u / np.sqrt(e)
        have = np.array([got[i][k].whitened for k in range(1, 17)])
        signs = np.sign(want * have) if signs is None else signs
        assert np.allclose(have * signs, want, atol=1e-8)
        assert np.allclose([got[i][k].explained for k in range(1, 17)], e / trace, rtol=1e-10)
        assert all(got[i][k].identity_error < 1e-9 and got[i][k].n == n for k in got[i])


def vectors(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def hostile(d=16):
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.standard_normal(d).tolist(), int(k % 3) if k % 4 else None) for k in range(90)]
    bad = [(100, None, 1), (101, [float("nan")] + [0.0] * (d - 1), 1), (102, [float("inf")] * d, 1), (103, [None] * d, 1), (104, [], 1), (105, [1.0, None] * (d // 2), None)]
    again = [rows[0], (5, rows[7][1], 2), (None, rows[7][1], None), (200, rows[7][1], 1)]
    return rows + bad + again


def test_whitening_of_hostile_rows(spark):
    rows = hostile()
    n, sums, e, u, trace, keep = plain_whitening([r[:2] for r in rows])
    assert n == 90
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 16 * len(keep) == 16 * 94
    of = defaultdict(list)
    for r in got:
        of[r.vec_id].append(r)
    assert len(of[0]) == 32 and len(of[None]) == 16 and len({r.whitened for r in of[0]}) == 16
    for i in (7, None):
        assert np.allclose([r.whitened for r in of[200]], [r.whitened for r in of[i]])
    assert np.allclose(sorted({r.explained for r in got}), sorted(e / trace))


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, 1)])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, k, 1, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(vectors(spark, [(1, [0.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [5.0, 2.0], 1)])).collect()
    assert [r.whitened is None for r in line] == [False, True] * 3 and np.allclose([r.explained for r in line], [1, 0] * 3) and line[0].identity_error < 1e-12
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(vectors(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]))


def test_clashing_columns_of_vectors(spark):
    df = vectors(spark, hostile()).withColumns({"x": F.lit("a"), "v": F.lit(1), "codes": F.lit(2), "error": F.lit(3), "component": F.lit(4), "n": F.lit(5)})
    assert whitening.whiten(df).count() == 16 * 94
    assert vector_codes.compress(df).count() == 94


# ---------------------------------------------------------------- codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    keep = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    keep = [(i, [math.floor(256 * float(c)) for c in v], label) for i, v, label in keep]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(keep[0][1]) // parts

    def cut(x, p):
        return tuple(x[p * w : (p + 1) * w])

    books = [[cut(x, p) for _, x, _ in keep[:entries]] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        got = [[nearest(x, p)[1] for p in range(parts)] for _, x, _ in keep]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(x, p) for (_, x, _), g in zip(keep, got, strict=True) if g[p] == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out, by = [], defaultdict(int)
    for i, x, label in keep:
        near = [nearest(x, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(e for e, _ in near), label))
        by[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()
    return sorted(str((i, c, e, by[label], digest)) for i, c, e, label in out)


def compressed(df):
    return sorted(str(tuple(r)) for r in vector_codes.compress(df).collect())


def test_codes_of_hostile_rows(spark):
    rows = [r for r in hostile()]
    assert compressed(vectors(spark, rows)) == plain_codes(rows)
    few = rows[:5]
    assert compressed(vectors(spark, few)) == plain_codes(few)
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 17, 1)]))


def test_codes_with_many_ties_and_wide_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), (rng.integers(-2, 3, 48) / 256).tolist(), 1) for k in range(300)]
    assert compressed(vectors(spark, rows)) == plain_codes(rows)


def test_exponion_is_exact_and_computes_less(spark):
    rng = np.random.default_rng(4)
    for spread in (1, 3, 200):
        entries = rng.integers(-spread, spread + 1, (64, 4)) + 40 * rng.integers(-3, 4, (64, 1))
        parts = rng.integers(-spread, spread + 1, (4000, 4)) + 40 * rng.integers(-3, 4, (4000, 1))
        apart = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        best, least, _ = vector_codes.Exponion(entries)(parts, rng.integers(0, 64, 4000))
        assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
        again, _, computed = vector_codes.Exponion(entries)(parts, best)
        assert (again == best).all()
        if spread < 200:
            assert computed < 0.6 * apart.size


def test_vector_tables_are_deleted(spark):
    root = os.path.dirname(new_path(spark, "x")).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    QUERIES["op12_whitening"](spark, SF).count()
    assert not set(os.listdir(root)) - before
    QUERIES["op13_vector_codes"](spark, SF).count()
    assert len(set(os.listdir(root)) - before) == 1  # the result's own table
