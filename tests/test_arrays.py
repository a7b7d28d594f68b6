import itertools
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import mathfn, tensor
from corpusmill.functions.tensor import Layout


def test_layout():
    assert Layout((2, 3, 4)).strides == (12, 4, 1)
    p = Layout((2, 3)).permute((1, 0))
    assert not p.is_contiguous and p.contiguous(list(range(6))) == [0, 3, 1, 4, 2, 5]
    assert not Layout((1, 3), (999, 1)).is_contiguous
    assert [Layout((2, 3)).offset(i) for i in Layout((2, 3)).walk()] == list(range(6))
    assert Layout(()).is_scalar and Layout(()).size == 1 and Layout((0, 3)).is_empty and Layout((2, 3)).rank == 2
    v = Layout((2, 3, 4)).slice(1, 1, 3).select(0, 1)
    assert v.shape == (2, 4) and v.contiguous(list(range(24))) == [16, 17, 18, 19, 20, 21, 22, 23]
    for i in itertools.product(range(2), range(3), range(4)):
        assert Layout((2, 3, 4)).unravel(Layout((2, 3, 4)).ravel(i)) == i
    for bad in (lambda: Layout((2, 3)).permute((0, 0)), lambda: Layout((2,)).offset((2,)), lambda: Layout((2,)).slice(0, 1, 3), lambda: Layout((2,)).select(1, 0)):
        with pytest.raises((ValueError, IndexError)):
            bad()


def test_tables(spark):
    rows = spark.createDataFrame([(i, [float(i * 3 + j) for j in range(3)]) for i in range(2)], "i long, v array<float>")
    t = tensor.from_rows(rows, "i", "v")
    got = tensor.contiguous(tensor.permute(t, (1, 0)), (3, 2)).orderBy("lead").collect()
    assert [list(r["values"]) for r in got] == [[0, 3], [1, 4], [2, 5]]
    changed = tensor.set_value(t, (1, 2), F.lit(9.0)).where("idx[0] = 1 and idx[1] = 2").first()
    assert changed.value == 9
    assert {tuple(r.idx) for r in tensor.select_dim(t, 0, 1).collect()} == {(0,), (1,), (2,)}


def test_math(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 3.0], [1.0, 1.0, 1.0, 1.0])], "x array<double>, y array<double>")
    r = df.select(
        mathfn.softmax(F.col("x")).alias("s"), mathfn.log_softmax(F.col("x")).alias("l"), mathfn.top_k(F.col("x"), 3).alias("t"), mathfn.top_k(F.col("x"), 9).alias("all"),
        mathfn.sample_greedy(F.col("x")).alias("g"), mathfn.rmse(F.col("x"), F.col("y")).alias("r"),
    ).first()
    z = sum(math.exp(v) for v in (1, 3, 2, 3))
    assert r.s == pytest.approx([math.exp(v) / z for v in (1, 3, 2, 3)])
    assert r.l == pytest.approx([v - math.log(z) for v in (1, 3, 2, 3)])
    assert r.t == [1, 3, 2] and r.all == [1, 3, 2, 0] and r.g == 1 and r.r == pytest.approx(1.5)
    g = spark.createDataFrame([([[-1.0, -2.0], [-3.0, -4.0]], [0, 1, 0])], "lp array<array<double>>, t array<int>")
    assert g.select(mathfn.gather_next(F.col("lp"), F.col("t"))).first()[0] == [-2.0, -3.0]
    with pytest.raises(Exception, match="lengths differ"):
        df.select(mathfn.mse(F.col("x"), F.array(F.lit(1.0)))).collect()
