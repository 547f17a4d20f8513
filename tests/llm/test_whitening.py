"""Whitening against a decomposition of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry, whitening


def table(spark, vectors, path):
    rows = [(i if i % 7 else None if i == 14 else i, v, 1, 2.0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x double").repartition(5)
    df.write.parquet(f"{path}/embeddings.parquet")
    return rows


def data(n=900, d=12):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(n, d)) * np.linspace(0.05, 0.4, d) + rng.normal(size=d)).astype(np.float32).tolist()
    x += [x[0]] * 300  # a hot vector
    bad = [None, [None, *x[1][1:]], [math.nan, *x[1][1:]], [*x[1][:-1], math.inf], [-math.inf, *x[1][1:]], []]
    return x[:450] + bad + x[450:]


def test_query_against_brute_force(spark, tmp_path):
    rows = table(spark, data(), tmp_path)
    fine = [(k, v) for k, v, *_ in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(1024 * np.float64(np.float32(e))) + 100000 for e in v] for _, v in fine], np.int64)
    n, s = len(x), x.sum(axis=0)
    exact = [[int(v) * n - int(t) for v, t in zip(row, s.tolist(), strict=True)] for row in x.tolist()]
    centred = np.array(exact, float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    df = registry.QUERIES["op12_embedding_whitening"](spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    signs = {}
    want = sorted(((k is None, k or 0), c + 1, sum(t * t for t in dev), float(centred[i] @ v[:, c] / math.sqrt(e[c])), e[c] / e.sum()) for i, ((k, _), dev) in enumerate(zip(fine, exact, strict=True)) for c in range(8))
    mine = sorted(((r.vec_id is None, r.vec_id or 0), r.component, r.deviation, r.whitened, r.explained) for r in got)
    for a, b in zip(mine, want, strict=True):
        assert a[:3] == b[:3] and a[4] == pytest.approx(b[4], rel=1e-9)
        sign = signs.setdefault(a[1], 1 if a[3] * b[3] > 0 else -1)
        assert a[3] == pytest.approx(sign * b[3], abs=1e-8)


@pytest.mark.parametrize(("batch", "parts"), [(4096, 1), (7, 40), (1, 3)])
def test_merging_loses_nothing(spark, batch, parts):
    x = np.random.default_rng(2).integers(-1000, 1000, (500, 6)) + 100000
    df = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(parts)
    got = whitening.fit(df, fan=3, batch=batch)
    assert got.n == 500 and got.sums.tolist() == x.sum(axis=0).tolist()
    centred = x - x.mean(axis=0)
    assert np.allclose(got.factor.T @ got.factor, centred.T @ centred, rtol=1e-12, atol=1e-4)
    assert len(got.factor) <= 6


def test_small_and_flat_tables(spark):
    vectors = lambda rows: spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "key long, x array<long>")
    assert whitening.whiten(vectors([])).collect() == []
    assert whitening.whiten(vectors([[1, 2]])).collect() == []  # no spread
    assert whitening.whiten(vectors([[5, 5]] * 4)).collect() == []
    assert {r.deviation for r in whitening.whiten(vectors([[0, 7], [2, 7], [4, 7]]), deviation=False).collect()} == {None}
    flat = whitening.whiten(vectors([[0, 7], [2, 7], [4, 7]])).collect()  # one dimension of two has any spread
    assert sorted((r.key, r.component, r.deviation) for r in flat) == [(0, 1, 36), (1, 1, 0), (2, 1, 36)] and flat[0].explained == 1
    wide = whitening.whiten(vectors([[0, 1], [3, 1], [4, 9], [1, 2, 3], [1]])).collect()
    assert {r.key for r in wide} == {0, 1, 2} and {r.n for r in wide} == {3}


def test_exact_beyond_sixty_four_bits(spark):
    model = whitening.Whitening(1 << 40, np.array([5 << 40]), np.ones(1), np.ones((1, 1)), 1.0)
    centred, deviation = model.centred(np.array([[7], [5]]))
    assert centred.tolist() == [[2.0], [0.0]] and deviation.tolist() == [(2 << 40) ** 2, 0]
    big = whitening.clean(spark.createDataFrame([(1, [1e300])], "k long, v array<double>"), "k", "v", lambda c: F.floor(c))
    with pytest.raises(Exception, match="too large"):
        big.collect()
