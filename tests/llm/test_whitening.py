"""Whitening against numpy's dense eigensolver, exact deviations, and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.llm import whitening as W

KIND = "vec_id long, embedding array<float>, x string, id int, component string"


def quantise(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 24)) * np.linspace(2, 0.3, 24)) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    out = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    out += [(1000 + i, out[7][1]) for i in range(150)] + [(7, out[7][1]), (None, out[9][1])]  # copies, a repeated row, a null id
    return out + [(2000, None), (2001, []), (2002, [1.0] * 23 + [None]), (2003, [math.nan] + [0.0] * 23), (2004, [math.inf] * 24), (2005, [0.5] * 3), (2006, [0.0] * 24)]


def whitened(spark, rows):
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], KIND).repartition(3)
    return W.whiten(df.select("vec_id", W.quantised(F.col("embedding")).alias("embedding"), "x", "id", "component"))


def test_equals_dense_solver(spark, rows):
    got = whitened(spark, rows).collect()
    used = [(i, q) for i, v in rows if (q := quantise(v)) is not None and len(q) == 24]
    fit = np.array(sorted({tuple(q) for _, q in used}), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 16 * len(used)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(by[7, 1]) == 2 and (None, 1) in by and {2000, 2001, 2002, 2003, 2004, 2005}.isdisjoint(i for i, _ in by)
    sums = [sum(int(r[j]) for r in fit) for j in range(24)]
    z = np.array([[by[i, c + 1][0]["whitened"] for c in range(16)] for i, _ in used])
    want = (np.array([q for _, q in used], dtype=float) - mean) @ vectors / np.sqrt(values)
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-8
    assert np.allclose([by[0, c + 1][0]["explained"] for c in range(16)], values / np.trace(cov), rtol=1e-10)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    for i, q in used:
        assert by[i, 3][0]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(q, sums))


def test_residuals_and_few_products():
    rng = np.random.default_rng(2)
    for d, n in ((64, 4000), (150, 3000), (5, 50)):
        x = rng.normal(size=(n, d))
        calls = []
        values, vectors, rest = W.jacobi_davidson(lambda q: calls.append(1) or x.T @ (x @ q) / n, d, 16)
        k = min(16, d)
        assert np.allclose(values, np.linalg.eigvalsh(x.T @ x / n)[::-1][:k], rtol=1e-12)
        assert rest.max() <= 1e-12 * values[0] and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert len(calls) < 300


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 40))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    q, theta = vectors[:, -6:], values[-3:]
    p = np.eye(40) - q @ q.T
    b = p @ rng.normal(size=(40, 3))
    t = W.minres(lambda v: a @ v, q, theta, b, 80, 1e-12)
    for i in range(3):
        assert np.abs(p @ (a - theta[i] * np.eye(40)) @ t[:, i] - b[:, i]).max() < 1e-8
    assert np.abs(q.T @ t).max() < 1e-10


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(6)
    flat = rng.integers(-50, 50, size=(80, 3)) @ rng.integers(-3, 4, size=(3, 20))
    got = whitened(spark, [(i, [float(c) for c in v]) for i, v in enumerate(flat)]).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and len(got) == 240 and got[0]["identity_error"] < 1e-9


def test_nothing_to_fit(spark, rows):
    assert whitened(spark, [(1, None)]).count() == 0
    assert whitened(spark, [(1, [1.0, 2.0])] * 3).count() == 0
    assert whitened(spark, rows[:1]).limit(0).count() == 0


def test_deviations_beyond_64_bits():
    big = W.Centre(3, [10 ** 15, -(10 ** 15)])
    x = np.array([[10 ** 16, 5], [-(10 ** 14), 7]], dtype=np.int64)
    want = [sum((3 * v - s) ** 2 for v, s in zip(r, big.sums)) for r in x.tolist()]
    assert W.deviations(x, big) == [w if w < 2 ** 63 else None for w in want]
    assert W.deviations(np.array([[4, 9]]), W.Centre(2, [3, 5])) == [5 * 5 + 13 * 13]


def test_partial_sums_in_two_levels(spark, monkeypatch):
    df = spark.range(500).select(F.array(F.col("id"), F.col("id") % 7, F.col("id") * F.col("id") % 11).alias("x")).repartition(9)
    fit = W.FitList(df, 3)
    once = fit.product(np.eye(3))
    monkeypatch.setattr(W, "_DIRECT", 0)
    assert np.allclose(fit.product(np.eye(3)), once, rtol=1e-13)
    x = np.array([[i, i % 7, i * i % 11] for i in range(500)], dtype=float)
    assert np.allclose(once, np.cov(x.T, bias=True), rtol=1e-12)


def test_a_large_offset_costs_no_digits(spark):
    x = np.array([[(i * 7) % 50, (i * i) % 31, i % 5] for i in range(60)])
    make = lambda off: W.fit_whitening(spark.createDataFrame([([int(c) + off for c in r],) for r in x], "v array<bigint>"), "v", 3)
    near, far = make(0), make(1 << 50)
    assert np.allclose(near.values, far.values, rtol=1e-12)
