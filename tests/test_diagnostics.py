"""Reliability, resilience, fairness: brute force and identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import fairness, metrics, reliability as rel, resilience as res


def _psi_numpy(e, a, buckets=10):
    e, a = np.asarray(e, float), np.asarray(a, float)
    bp = np.arange(0, buckets + 1) / buckets * 100
    bp = bp / (bp.max() / (e.max() - e.min())) + e.min()
    ep = np.histogram(e, bp)[0] / len(e)
    ap = np.histogram(a, bp)[0] / len(a)
    ep = np.where(ep == 0, 0.0001, ep)
    ap = np.where(ap == 0, 0.0001, ap)
    return float(np.sum((ep - ap) * np.log(ep / ap)))


def test_conformal_pvalues_bruteforce(spark):
    rng = np.random.default_rng(3)
    cal = np.round(rng.uniform(size=200), 2)
    tst = np.round(rng.uniform(size=50), 2)
    c = spark.createDataFrame([(float(v),) for v in cal], "strangeness double")
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(tst)], "id long, strangeness double")
    got = {r["id"]: r["p_value"] for r in rel.conformal_pvalues(c, t).collect()}
    for i, v in enumerate(tst):
        assert math.isclose(got[i], float((cal >= v).mean()))
    cut = rel.cutoff(c, alpha=0.95).first()["cutoff"]
    assert math.isclose(cut, float(np.percentile(cal, 95)))


def test_calibration_edges_go_to_lower_bin(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2), (1, 0.25), (0, 0.0), (1, 1.0)], "y int, p double")
    got = {r["bin"]: r["count"] for r in rel.calibration_curve(df).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 9: 1}


def test_psi_matches_numpy_and_identity(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=300)
    a = rng.normal(0.3, 1.2, size=200)
    rows = [("expected", float(v)) for v in e] + [("actual", float(v)) for v in a]
    df = spark.createDataFrame(rows, "side string, x double")
    got = res.psi(df, ["x"]).first()["psi"]
    assert math.isclose(got, _psi_numpy(e, a), rel_tol=1e-9)
    same = spark.createDataFrame([("expected", float(v)) for v in e] + [("actual", float(v)) for v in e],
                                 "side string, x double")
    assert abs(res.psi(same, ["x"]).first()["psi"]) < 1e-12


def test_wasserstein_and_ks(spark):
    rng = np.random.default_rng(9)
    u = np.round(rng.normal(size=120), 1)
    v = np.round(rng.normal(0.5, 1, size=80), 1)
    rows = [("expected", float(x)) for x in u] + [("actual", float(x)) for x in v]
    r = res.distribution_distances(spark.createDataFrame(rows, "side string, x double"), ["x"]).first()
    grid = np.unique(np.r_[u, v])
    F_ = np.searchsorted(np.sort(u), grid, side="right") / len(u)
    G_ = np.searchsorted(np.sort(v), grid, side="right") / len(v)
    wd = float(np.sum(np.abs(F_ - G_)[:-1] * np.diff(grid)))
    assert math.isclose(r["wasserstein"], wd, rel_tol=1e-9)
    assert math.isclose(r["ks"], float(np.max(np.abs(F_ - G_))), rel_tol=1e-12)


def test_worst_samples_and_sweep(spark):
    rng = np.random.default_rng(11)
    n = 97
    y = rng.integers(0, 2, n)
    p = np.round(rng.uniform(size=n), 1)
    df = spark.createDataFrame([(f"r{i}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "id string, y int, p double")
    scored = res.residual_column(df)
    w = res.worst_samples(scored, 0.1)
    assert w.count() == int(0.1 * n)
    worst_res = sorted((r["residual"] for r in w.collect()), reverse=True)
    all_res = sorted(np.abs(p - y), reverse=True)
    assert np.allclose(worst_res, all_res[:int(0.1 * n)])
    sweep = {r["level"]: r for r in res.resilience_sweep(scored, "ACC").collect()}
    assert math.isclose(sweep[10]["value"], sweep[10]["overall"])


def test_decile_bins_like_qcut(spark):
    x = [1.0] * 30 + [float(i) for i in range(2, 72)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    out = res.decile_bins(df, "x").collect()
    assert all(r["bin"] is not None for r in out)        # lowest value included
    edges = np.unique(np.percentile(x, np.linspace(0, 1, 11) * 100))
    for r in out:
        assert r["bin"] == int(np.searchsorted(edges[1:-1], r["x"], side="left")) + 1


def test_fairness_bruteforce(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 1, 1), ("b", 0, 0), ("b", 0, 0), ("c", 0, 0)]
    df = spark.createDataFrame(rows, "g string, y int, yh int")
    got = {r["cls"]: r for r in fairness.fairness_ratios(df, ["g"], drop_undefined=False).collect()}
    a_rate, rest_rate = 2 / 3, 1 / 4
    assert math.isclose(got["a"]["air"], a_rate / rest_rate)
    assert math.isclose(got["a"]["pr"], (1 / 2) / (1 / 1))
    assert got["c"]["ppv_protected"] is None and got["c"]["pr"] is None   # no positive predictions
    reg = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), ("b", 5.0)], "g string, yh double")
    smd = {r["cls"]: r["smd"] for r in fairness.standardized_mean_difference(reg, ["g"]).collect()}
    pa, pb = np.array([1.0, 2.0]), np.array([4.0, 6.0, 5.0])
    pooled = math.sqrt(((len(pa) - 1) * pa.var(ddof=1) + (len(pb) - 1) * pb.var(ddof=1)) / (len(pa) + len(pb) - 2))
    assert math.isclose(smd["a"], (pa.mean() - pb.mean()) / pooled, rel_tol=1e-9)


def test_histogram_table_density(spark):
    x = [0.0, 0.1, 0.1, 0.5, 1.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    out = sorted((r["bin"], r["count"], r["density"]) for r in rel.histogram_table(df, "v", 10, density=True).collect())
    cnt, edges = np.histogram(x, bins=10, density=False)
    dens, _ = np.histogram(x, bins=10, density=True)
    assert [c for _, c, _ in out] == list(cnt)
    assert np.allclose([d for _, _, d in out], dens)


def test_time_slice_drift(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i * 7), float(i % 13), i % 2, (i + 1) % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, f1 double, y int, yh int")
    out = res.time_slice_drift(df, "ts", ["f1"], "1 day", metric="ACC", yh="yh").collect()
    assert sum(r["n"] for r in out) == 60
    assert all(r["score"] == 0.0 for r in out)


def test_smd_far_from_zero(spark):
    rng = np.random.default_rng(3)
    v, g = 1e9 + rng.normal(size=400), rng.integers(0, 3, 400)
    df = spark.createDataFrame([(f"g{b}", float(a)) for a, b in zip(v, g)], "g string, yh double")
    for r in fairness.standardized_mean_difference(df, ["g"], "yh").collect():
        mine = v[g == int(r["cls"][1:])]
        rest = v[g != int(r["cls"][1:])]
        pooled = np.sqrt((((mine - mine.mean()) ** 2).sum() + ((rest - rest.mean()) ** 2).sum()) / (len(v) - 2))
        assert abs(r["smd"] - (mine.mean() - rest.mean()) / pooled) < 1e-5
