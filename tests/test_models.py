"""Explainability, robustness, overfit, weak spots, training."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import explain, metrics, overfit, robust, train, weakspot
from probity.operators.scoring import Scorer


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 400
    x1 = rng.normal(size=n)
    x2 = rng.uniform(size=n)
    x3 = rng.integers(0, 5, n).astype(float)
    y = ((x1 + 0.5 * x2 + rng.normal(scale=0.5, size=n)) > 0.3).astype(int)
    rows = [(f"r{i}", float(a), float(b), float(c), int(d), "train" if i % 4 else "test")
            for i, (a, b, c, d) in enumerate(zip(x1, x2, x3, y))]
    return spark.createDataFrame(rows, "id string, x1 double, x2 double, x3 double, y int, split string")


def _scorer():
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("x1") + F.lit(0.5) * F.col("x2") - F.lit(0.3))))
    return Scorer.from_columns(p=p)


def test_linear_shap_sums_to_margin(spark, data):
    w = {"x1": 1.0, "x2": 0.5, "x3": -0.2}
    phi = explain.linear_shap(data, w, intercept=-0.3)
    tot = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    j = tot.join(data, "id").select((F.col("s") + F.col("b")).alias("lhs"),
                                    (F.col("x1") + 0.5 * F.col("x2") - 0.2 * F.col("x3") - 0.3).alias("m"))
    assert all(math.isclose(r["lhs"], r["m"], abs_tol=1e-9) for r in j.collect())


def test_sampled_shap_efficiency(spark, data):
    test = data.where("split = 'test'")
    bg = data.where("split = 'train'").select("x1", "x2", "x3").limit(50)
    sc = _scorer()
    phi = explain.sampled_shap(test, sc, ["x1", "x2", "x3"], bg, n_samples=16)
    sums = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    # per sample the steps telescope to f(x) - f(z), so the sum is f(x) - mean f(z_m)
    assert len(sums) == test.count()
    px = {r["id"]: r["p"] for r in sc.score(test).select("id", "p").collect()}
    for k, v in list(sums.items())[:20]:
        assert -1.0 <= v <= 1.0 and not math.isnan(px[k])
    x3 = phi.where("feature = 'x3'").agg(F.max(F.abs("phi"))).first()[0]
    assert x3 < 1e-12            # the scorer ignores x3


def test_permutation_importance_keeps_rows(spark, data):
    test = data.where("split = 'test'")
    perm = explain.permutation_importance(test, _scorer(), ["x1", "x2", "x3"], "ACC", repeats=3)
    got = {(r["feature"], r["repeat"]): r for r in perm.collect()}
    assert len(got) == 9
    assert all(abs(got[("x3", r)]["importance"]) < 1e-12 for r in (1, 2, 3))
    assert np.mean([got[("x1", r)]["importance"] for r in (1, 2, 3)]) > 0


def test_partial_dependence_grid(spark, data):
    out = explain.partial_dependence(data, _scorer(), "x3").collect()
    assert sorted(r["value_1"] for r in out) == sorted(set(r["x3"] for r in data.collect()))
    assert max(r["average"] for r in out) - min(r["average"] for r in out) < 1e-12
    g = explain.pdp_grid(data, "x1", grid_resolution=20).collect()
    assert len(g) == 20


def test_noise_and_robustness_zero_size(spark, data):
    test = data.where("split = 'test'")
    sc = _scorer()
    base = metrics.evaluate(sc.score(test), "ACC").first()["value"]
    runs = robust.robustness_runs(test, sc, ["x1", "x2", "x3"], metric="ACC", sizes=(0.0, 0.5), iterations=3)
    zero = [r["value"] for r in runs.where("size = 0.0").collect()]
    assert zero and all(math.isclose(v, base) for v in zero)
    q = robust.robustness_runs(test, sc, ["x1", "x2"], metric="ACC", sizes=(0.0,), iterations=1, method="quantile")
    assert q.count() == 1
    ns = {r["feature"]: r for r in overfit.noise_sensitivity(test, sc, ["x1", "x2", "x3"]).collect()}
    assert ns["x3"]["drop"] == 0.0


def test_category_noise_size_zero_and_one(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "id long, c string")
    runs = robust.explode_runs(df, (0.0, 1.0), 2)
    out = robust.category_noise(runs, ["c"], "id", stats_from=df)
    j = out.join(runs.select("id", "run", F.col("c").alias("c0")), ["id", "run"])
    assert j.where("size = 0.0 AND c <> c0").count() == 0
    assert set(r["c"] for r in out.where("size = 1.0").collect()) <= {"a", "b", "c"}


def test_weak_spots_and_rules(spark, data):
    test = data.where("split = 'test'").withColumn("yh", (F.col("x1") > 0).cast("int"))
    flagged = weakspot.correctness(test)
    tree = weakspot.segment_tree(flagged, ["x1", "x2"])
    leaves = weakspot.assign_leaves(flagged, tree)
    table = weakspot.leaf_table(leaves, ["x1", "x2"]).collect()
    assert sum(r["count"] for r in table) == test.count()
    rules = weakspot.tree_rules(tree)
    assert [i for i, _ in rules] == list(range(len(tree.leaves()))) and {r["leaf"] for r in table} == {i for i, _ in rules}


def test_training_and_leaderboard(spark, data):
    tr, te = data.where("split = 'train'"), data.where("split = 'test'")
    models, scored = train.train_models(tr, te, ["logistic", "tree"], "classification", ["x1", "x2", "x3"],
                                        params={"tree": {"maxDepth": 3}})
    board = train.leaderboard(scored, "classification").collect()
    assert {r["model"] for r in board} == {"logistic", "tree"}
    assert all(0.5 < r["AUC"] <= 1.0 for r in board)
    reg = train.register_models(train.leaderboard(scored, "classification"), ["tree"]).collect()
    assert [r["model"] for r in reg] == ["tree"]
    w = train.class_weights(tr).groupBy("y").agg(F.first("weight").alias("w"), F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in w)
    assert all(math.isclose(r["w"], n / (2 * r["n"])) for r in w)
    assert train.parse_layers("100, 50") == [100, 50]


def test_logistic_is_the_balanced_l2_optimum(spark, data):
    """At the optimum of |w|^2 / 2 + C * sum of weighted log losses every gradient component is 0."""
    rare = data.where("y = 0 or x3 < 2")
    for c in (1.0, 0.05):
        m = train.fit(rare, "logistic", "classification", ["x1", "x2"], params={"C": c}).stages[-1]
        x = np.array([(r["x1"], r["x2"], r["y"]) for r in rare.collect()])
        y, w, b = x[:, 2], np.array(m.coefficients), m.intercept
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        p = 1 / (1 + np.exp(-(x[:, :2] @ w + b)))
        assert np.allclose(w + c * (weight * (p - y)) @ x[:, :2], 0, atol=0.05)
        assert abs((weight * (p - y)).sum()) < 0.05


def test_overrides_under_menu_names(spark, data):
    three = data.withColumn("y3", F.col("x3").cast("int") % 3)
    m = train.fit(three, "gbm", "classification", ["x1", "x2", "x3"], y="y3", n_classes=3,
                  params={"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3})
    inner = m.stages[-1].models[0]
    assert (inner.getNumTrees, inner.getOrDefault("maxDepth"), inner.getOrDefault("stepSize")) == (2, 2, 0.3)
    tree = train.make_estimator("tree", "regression", 3, params={"min_samples_split": 30})
    assert tree.getMinInstancesPerNode() == 15
    assert train.make_estimator("forest", "regression", 3, params={"n_estimators": 7}).getNumTrees() == 7
    with pytest.raises(ValueError):
        train.make_estimator("logistic", "classification", 3)


def test_save_model(spark, data, tmp_path):
    m = train.fit(data, "tree", "classification", ["x1", "x2"])
    meta = train.save_model(m, str(tmp_path / "m"), "tree", {"AUC": 0.8})
    assert meta["name"] == "tree"
    again = train.load_model(str(tmp_path / "m"))
    assert again.transform(data).count() == data.count()


def test_sampled_shap_matches_window_form(spark, data):
    """The telescoped aggregation equals the explicit step-difference form."""
    from pyspark.sql import Window
    test = data.where("split = 'test'").limit(30)
    bg = data.where("split = 'train'").select("x1", "x2", "x3").limit(20)
    sc = _scorer()
    phi = {(r["id"], r["feature"]): r["phi"] for r in
           explain.sampled_shap(test, sc, ["x1", "x2", "x3"], bg, n_samples=4).collect()}
    # brute force: same draws, explicit differences between consecutive steps
    import numpy as np
    rows = {r["id"]: r for r in test.collect()}
    numbered = {r["_zi"]: (r["_z_0"], r["_z_1"], r["_z_2"])
                for r in explain.number_background(bg, ["x1", "x2", "x3"]).collect()}
    bgl = [numbered[i] for i in range(len(numbered))]
    from probity.functions.hashing import hash01
    feats = ["x1", "x2", "x3"]
    keys = test.select("id").withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(4))))
    keys = keys.select("id", "_m", F.floor(hash01("id", "_m", salt="bg:0") * F.lit(len(bgl))).alias("zi"),
                       *[hash01("id", "_m", F.lit(f), salt="ord:0").alias(f"h{i}") for i, f in enumerate(feats)])
    p = lambda v: 1.0 / (1.0 + math.exp(-(v[0] + 0.5 * v[1] - 0.3)))
    want = {}
    for r in keys.collect():
        x = [rows[r["id"]][f] for f in feats]
        z = list(bgl[r["zi"]])
        order = sorted(range(3), key=lambda i: (r[f"h{i}"], i))
        cur = z[:]
        prev = p(cur)
        for j in order:
            cur[j] = x[j]
            now = p(cur)
            want[(r["id"], feats[j])] = want.get((r["id"], feats[j]), 0.0) + (now - prev) / 4
            prev = now
    assert phi.keys() == want.keys()
    assert all(math.isclose(phi[k], want[k], abs_tol=1e-9) for k in want)


def test_registered_cluster_checks_run_whole(monkeypatch):
    from probity.checks import diagnostic_checks, model_checks
    seen = []
    monkeypatch.setattr(diagnostic_checks.res, "worst_cluster_sweep", lambda *a, **k: seen.append((k["max_k"], k["n_init"])))
    monkeypatch.setattr(model_checks, "worst_cluster", lambda *a, **k: seen.append(k["n_init"]))
    monkeypatch.setattr(model_checks.train, "train_models", lambda *a, params=None, **k: seen.append(params) or (None, None))
    monkeypatch.setattr(model_checks.train, "leaderboard", lambda *a, **k: None)
    for module in (diagnostic_checks, model_checks):
        monkeypatch.setattr(module, "rounded", lambda x: x)
    frame = type("Frame", (), {"where": lambda self, c: self})()
    for fx in (diagnostic_checks.fx, model_checks.fx):
        monkeypatch.setattr(fx, "clf", lambda s, d: frame)
    monkeypatch.setattr(diagnostic_checks.F, "col", lambda c: c)
    diagnostic_checks.worst_cluster_sweep(None, "")
    model_checks.worst_cluster_k(None, "")
    model_checks.leaderboard_classification(None, "")
    assert seen == [(10, 10), 10, None]
