"""Explanations of several classes and over quartile bins, against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import explain
from probity.operators.scoring import Scorer

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), float(rng.uniform()), "train" if i % 3 else "test") for i in range(240)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, split string")


def _logits(a, b, c):
    return np.stack([np.exp(0.5 * a), np.exp(0.3 * b - c), np.ones_like(a)], axis=-1)


def _three():
    def fn(df):
        e = [F.exp(F.lit(0.5) * F.col("a")), F.exp(F.lit(0.3) * F.col("b") - F.col("c")), F.lit(1.0)]
        out = df.withColumn("probs", F.array(*[x / (e[0] + e[1] + e[2]) for x in e]))
        return out.withColumn("yh", F.array_position("probs", F.array_max("probs")).cast("int") - F.lit(1))
    return Scorer(fn=fn, n_classes=3)


def _probs(x):
    e = _logits(x[..., 0], x[..., 1], x[..., 2])
    return e / e.sum(axis=-1, keepdims=True)


def _draws(key, salt, n):
    out = []
    for j in range(-(-n // 4)):
        digest = hashlib.md5(f"{salt}#{j}:{key}".encode()).hexdigest()
        out += [(int(digest[8 * w:8 * w + 8], 16) + 0.5) / 2 ** 32 for w in range(4)]
    return out[:n]


def test_sampled_shap_of_classes_equals_a_plain_walk(table):
    test, train = table.where("split = 'test'"), table.where("split = 'train'")
    got = {(r["id"], r["feature"], r["cls"]): r["phi"] for r in explain.sampled_shap(
        test, _three(), FEATS, train, n_samples=4, background_id="id").collect()}
    back = sorted(train.collect(), key=lambda r: (int(hashlib.md5(f"bgn:0:{r['id']}".encode()).hexdigest()[:8], 16), r["id"]))
    want = {}
    for r in test.collect():
        x = np.array([r[f] for f in FEATS])
        for m in range(1, 5):
            z = back[math.floor(int(hashlib.md5(f"bg:0:{r['id']}:{m}".encode()).hexdigest()[:15], 16) / 2 ** 60 * len(back))]
            now = np.array([z[f] for f in FEATS])
            u = [int(hashlib.md5(f"ord:0:{r['id']}:{m}:{f}".encode()).hexdigest()[:8], 16) for f in FEATS]
            for i in sorted(range(3), key=lambda j: (u[j], j)):
                before = _probs(now)
                now[i] = x[i]
                for c, step in enumerate(_probs(now) - before):
                    want[(r["id"], FEATS[i], c)] = want.get((r["id"], FEATS[i], c), 0.0) + step / 4
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_predicted_class_has_data_and_a_base_that_adds_up(table):
    test, train = table.where("split = 'test'"), table.where("split = 'train'")
    phi = explain.sampled_shap(test, _three(), FEATS, train, n_samples=3).cache()
    rows = explain.shap_predicted(phi, test, _three(), FEATS).collect()
    x = {r["id"]: np.array([r[f] for f in FEATS]) for r in test.collect()}
    assert len(rows) == 3 * len(x)
    for i, v in x.items():
        mine = [r for r in rows if r["id"] == i]
        p = _probs(v)
        assert {r["cls"] for r in mine} == {int(p.argmax())}
        assert {r["feature"]: r["data"] for r in mine} == dict(zip(FEATS, v))
        assert math.isclose(sum(r["phi"] for r in mine) + mine[0]["base"], p.max(), abs_tol=1e-12)
    total = {r["feature"]: r["mean_abs_phi"] for r in explain.shap_global(phi, by_class=True).collect()}
    plain = {}
    for r in phi.collect():
        plain[r["feature"]] = plain.get(r["feature"], 0.0) + abs(r["phi"]) / len(x)
    assert all(math.isclose(total[f], plain[f], abs_tol=1e-12) for f in FEATS)


def test_quartile_bins(table):
    train = table.where("split = 'train'")
    bins = explain.quartile_bins(train, FEATS)
    for f in FEATS:
        v = np.array([r[f] for r in train.collect()])
        edges = np.unique(np.percentile(v, [25, 50, 75]))
        assert np.allclose(bins[f]["edges"], edges)
        at = np.searchsorted(edges, v)
        for b in range(len(edges) + 1):
            assert math.isclose(bins[f]["share"][b], np.mean(at == b), abs_tol=1e-12)
            if (at == b).any():
                assert math.isclose(bins[f]["mean"][b], v[at == b].mean(), abs_tol=1e-9)
                assert math.isclose(bins[f]["std"][b], v[at == b].std(), abs_tol=1e-9)
        assert bins[f]["low"][0] == v.min() and bins[f]["high"][-1] == v.max()


def test_truncated_quantiles_follow_the_cut_normal():
    from statistics import NormalDist
    n = NormalDist(1.0, 2.0)
    got = explain._truncated_quantiles(1.0, 2.0, 0.0, 4.0)
    assert got[0] == 0.0 and got[-1] == 4.0 and got == sorted(got)
    share = (n.cdf(got[64]) - n.cdf(0.0)) / (n.cdf(4.0) - n.cdf(0.0))
    assert math.isclose(share, 64 / explain._KNOTS, abs_tol=1e-9)
    assert set(explain._truncated_quantiles(3.0, 0.0, 1.0, 5.0)) == {3.0}


def test_lime_equals_a_plain_weighted_ridge(table):
    test, train = table.where("split = 'test' and id < 30"), table.where("split = 'train'")
    got = {(r["id"], r["cls"], r["feature"]): r for r in explain.lime(test, _three(), FEATS, train, n_samples=40).collect()}
    bins = explain.quartile_bins(train, FEATS)
    knots = {f: [explain._truncated_quantiles(*a) for a in zip(bins[f]["mean"], bins[f]["std"], bins[f]["low"], bins[f]["high"])] for f in FEATS}
    width = 0.75 * math.sqrt(3)
    rows = test.collect()
    assert len(got) == 9 * len(rows)
    for r in rows:
        x = np.array([r[f] for f in FEATS])
        own = [int(np.searchsorted(bins[f]["edges"], r[f])) for f in FEATS]
        z, made = [np.ones(3)], [x]
        for s in range(1, 40):
            u = _draws(f"{r['id']}:{s}", "lime:0", 6)
            b = [int(np.searchsorted(np.cumsum(bins[f]["share"])[:-1], u[2 * i], side="right")) for i, f in enumerate(FEATS)]
            z.append(np.array([float(p == q) for p, q in zip(b, own)]))
            grid = np.arange(explain._KNOTS + 1) / explain._KNOTS
            made.append(np.array([np.interp(u[2 * i + 1], grid, knots[f][b[i]]) for i, f in enumerate(FEATS)]))
        z, target = np.array(z), _probs(np.array(made))
        w = np.sqrt(np.exp(-((z - 1) ** 2).sum(axis=1) / width ** 2))
        design = np.hstack([np.ones((40, 1)), z])
        gram = design.T @ (design * w[:, None]) + np.diag([0.0, 1.0, 1.0, 1.0])
        for c in range(3):
            coef = np.linalg.solve(gram, design.T @ (w * target[:, c]))
            for j, f in enumerate(FEATS):
                row = got[(str(r["id"]), c, f)]
                assert math.isclose(row["weight"], coef[j + 1], abs_tol=1e-9)
                assert math.isclose(row["intercept"], coef[0], abs_tol=1e-9)
                assert row["score"] <= 1.0 + 1e-9
