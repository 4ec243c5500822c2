"""Whitening against numpy's eigenvectors, and the polar iteration on awkward matrices."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from corpuspulse.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x string, n int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3, "y") for i, v in rows], SCHEMA)


def expected(rows, k=4):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _i, x in ok}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    w, v = np.linalg.eigh(y.T @ y / n)
    w, v = w[::-1], v[:, ::-1]
    x = np.array([x for _i, x in ok], dtype=np.int64)
    return [i for i, _x in ok], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, :k] / np.sqrt(w[:k]), w[:k] / w.sum()


def check(out, rows, k=4):
    ids, n, deviation, white, share = expected(rows, k)
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(r)
    assert {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    assert len(out) == k * len(ids)
    sign = {}
    for at, i in enumerate(ids):
        rows_ = [r for r in by[i]]
        assert {r.component for r in rows_} == set(range(1, k + 1))
        for r in rows_:
            c = r.component - 1
            sign.setdefault(c, 1 if r.whitened * white[at, c] >= 0 else -1)
            assert r.deviation == deviation[at] and abs(r.explained - share[c]) < 1e-9
            assert abs(r.whitened * sign[c] - white[at, c]) < 1e-8


def test_awkward_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(7)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)] + [(500, rows[6][1][:-1] + [rows[6][1][-1]])]
    bad = [(600, None), (601, []), (602, [1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0]), (603, [float("nan")] * 7), (604, [float("inf")] * 7),
           (605, [1e300] * 7), (606, [0.5] * 6)]
    check(W.whiten(frame(spark, rows + bad)).collect(), rows)
    zeros = [(i, [-0.0, 0.0, rng.random(), rng.random()]) for i in range(30)]
    check(W.whiten(frame(spark, zeros)).collect(), zeros, 2)   # only directions with variance are components
    assert W.whiten(frame(spark, [])).collect() == [] and W.whiten(frame(spark, bad[:5])).collect() == []
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    one = [(None, [0.5 * i]) for i in range(9)]
    assert {r.component for r in W.whiten(frame(spark, one)).collect()} == {1}
    far = W.whiten(frame(spark, [(i, [1e12 * (i % 3), float(i)]) for i in range(9)])).collect()
    assert any(r.deviation is None for r in far)


def test_the_query_on_the_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(entry.queries()["op13_whitening"](spark, sf).collect(), rows)


@pytest.mark.parametrize("kind", ["plain", "graded", "rank one", "repeated", "clustered", "zero"])
def test_spectral_components_match_eigh(kind):
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 17, 64):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        e = {"plain": rng.random(d) + 0.1, "graded": np.logspace(0, -9, d), "rank one": np.eye(1, d)[0], "repeated": rng.integers(1, 4, d) * 1.0,
             "clustered": 1 + 1e-9 * rng.random(d), "zero": np.zeros(d)}[kind]
        a = (q * e) @ q.T
        w, v = W.spectral_components(a)
        top = max(e.max(), 1e-300)
        assert np.abs(w - np.sort(e)[::-1]).max() <= 1e-13 * top
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-11 and np.abs(a @ v - v * w).max() <= 1e-12 * top


def test_polar_factor():
    rng = np.random.default_rng(9)
    for d in (1, 4, 30):
        for spread in (1, 1e-8, 1e-14):
            a = rng.standard_normal((d, d)) * np.geomspace(1, spread, d)
            u = W.polar(a)
            h = u.T @ a
            assert np.abs(u.T @ u - np.eye(d)).max() < 1e-13
            assert np.abs(h - h.T).max() < 1e-13 * np.abs(a).max() and np.linalg.eigvalsh((h + h.T) / 2).min() > -1e-13 * np.abs(a).max()
