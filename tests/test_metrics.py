"""Metrics against brute-force numpy versions of the documented definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import metrics as m


def _auc_bruteforce(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _roc_bruteforce(y, p, drop=True):
    order = np.argsort(-np.asarray(p), kind="mergesort")
    ys, ps = np.asarray(y)[order], np.asarray(p)[order]
    idx = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[idx]
    fps = (1 + idx) - tps
    thr = ps[idx]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fps, tps, thr = np.r_[0, fps], np.r_[0, tps], np.r_[np.inf, thr]
    return list(zip(thr, fps / fps[-1], tps / tps[-1]))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(42)
    n = 300
    y = rng.integers(0, 2, n)
    p = np.round(rng.uniform(0, 1, n) * 0.6 + y * 0.2, 2)   # ties on purpose
    rows = [(int(i), int(yi), float(pi), int(pi >= 0.5), "g" + str(i % 2)) for i, (yi, pi) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "id long, y int, p double, yh int, g string"), y, p


def test_auc_and_gini(scored):
    df, y, p = scored
    r = m.auc(df).first()
    assert math.isclose(r["auc"], _auc_bruteforce(y, p), rel_tol=1e-12)
    assert math.isclose(r["gini"], 2 * r["auc"] - 1, rel_tol=1e-12)


def test_auc_by_group_and_one_class(spark, scored):
    df, y, p = scored
    got = {r["g"]: r["auc"] for r in m.auc(df, by="g").collect()}
    for g in ("g0", "g1"):
        sel = [i for i in range(len(y)) if f"g{i % 2}" == g]
        assert math.isclose(got[g], _auc_bruteforce(y[sel], p[sel]), rel_tol=1e-12)
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    assert m.auc(one).first()["auc"] is None


def test_roc_curve_matches_sklearn_rule(scored):
    df, y, p = scored
    got = sorted((r["fpr"], r["tpr"], r["threshold"]) for r in m.roc_curve(df).collect())
    want = sorted((f, t, th) for th, f, t in _roc_bruteforce(y, p))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert math.isclose(a[0], b[0], abs_tol=1e-12) and math.isclose(a[1], b[1], abs_tol=1e-12)


def test_pr_curve_and_average_precision(scored):
    df, y, p = scored
    ap = m.average_precision(df).first()["average_precision"]
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    idx = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[idx]
    fps = (1 + idx) - tps
    prec, rec = tps / (tps + fps), tps / tps[-1]
    want = float(np.sum(np.diff(np.r_[0, rec]) * prec))
    assert math.isclose(ap, want, rel_tol=1e-12)
    pts = m.pr_curve(df).collect()
    assert len(pts) == len(idx) + 1
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pts)


def test_ks(scored):
    df, y, p = scored
    roc = _roc_bruteforce(y, p, drop=False)
    want = max(t - f for _, f, t in roc)
    assert math.isclose(m.ks_statistic(df).first()["ks"], want, abs_tol=1e-12)


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2), (1, 0, 0.3)], "y int, yh int, p double")
    r = m.binary_metrics(df).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert math.isclose(r["accuracy"], 2 / 3)
    assert math.isclose(r["specificity"], 1.0)
    assert math.isclose(r["brier"], (0.01 + 0.04 + 0.49) / 3)


def test_macro_and_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2), (2, 1)]
    df = spark.createDataFrame(rows, "y int, yh int")
    rep = {r["cls"]: r for r in m.classification_report(df).collect()}
    # class 1: tp=2, fp=2 (0->1, 2->1), fn=0
    assert math.isclose(rep[1]["precision"], 0.5) and rep[1]["recall"] == 1.0 and rep[1]["support"] == 2
    mac = m.macro_metrics(df).first()
    assert math.isclose(mac["precision_macro"], np.mean([r["precision"] for r in rep.values()]))
    cm = m.confusion_matrix(df).collect()
    assert sum(r["n"] for r in cm) == len(rows)


def test_auc_ovr(spark):
    rows = [(0, [0.7, 0.2, 0.1]), (1, [0.2, 0.5, 0.3]), (2, [0.1, 0.3, 0.6]), (0, [0.3, 0.4, 0.3]),
            (1, [0.5, 0.3, 0.2]), (2, [0.2, 0.2, 0.6])]
    df = spark.createDataFrame(rows, "y int, probs array<double>")
    got = {r["cls"]: r["auc"] for r in m.auc_ovr(df).collect()}
    for c in range(3):
        yc = [1 if y == c else 0 for y, _ in rows]
        pc = [pr[c] for _, pr in rows]
        assert math.isclose(got[c], _auc_bruteforce(yc, pc))


def test_regression_metrics(spark):
    rows = [(3.0, 2.5), (0.0, 0.5), (2.0, 2.0), (7.0, 8.0)]
    df = spark.createDataFrame(rows, "y double, yh double")
    r = m.regression_metrics(df, n_features=1).first()
    y = np.array([a for a, _ in rows]); yh = np.array([b for _, b in rows])
    assert math.isclose(r["mse"], np.mean((y - yh) ** 2))
    assert math.isclose(r["mae"], np.mean(np.abs(y - yh)))
    r2 = 1 - np.sum((y - yh) ** 2) / np.sum((y - y.mean()) ** 2)
    assert math.isclose(r["r2"], r2)
    assert math.isclose(r["adj_r2"], 1 - (1 - r2) * 3 / 2)
    nz = y != 0
    assert math.isclose(r["mape"], np.mean(np.abs((y[nz] - yh[nz]) / y[nz])) * 100)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, yh double")
    assert m.regression_metrics(const).first()["r2"] == 1.0


def test_evaluate_dispatch(scored):
    df, y, p = scored
    got = m.evaluate(df, "ACC").first()["value"]
    assert math.isclose(got, float(np.mean((p >= 0.5).astype(int) == y)))
    assert math.isclose(m.evaluate(df, "AUC").first()["value"], _auc_bruteforce(y, p))
    with pytest.raises(ValueError):
        m.evaluate(df, "BOGUS")


def test_empty_table(spark):
    df = spark.createDataFrame([], "y int, yh int, p double")
    assert m.binary_metrics(df).count() == 1
    r = m.auc(df).collect()
    assert len(r) == 1 and r[0]["auc"] is None


def test_null_group_is_kept(spark):
    rows = [(g, int(i % 2), i / 20.0, int(i > 10)) for g in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, y int, p double, yh int")
    for out in (m.auc(df, by="g"), m.average_precision(df, by="g"), m.ks_statistic(df, by="g"), m.macro_metrics(df, by="g")):
        assert {r["g"] for r in out.collect()} == {"a", None}
    for out in (m.roc_curve(df, by="g"), m.pr_curve(df, by="g")):
        got = out.collect()
        assert sum(r["g"] is None for r in got) == sum(r["g"] == "a" for r in got) > 2
