"""Tree models fitted on counted cells: the models of the rows, whatever the number of rows behind a cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import binned, train

FEATURES = ["a", "b", "c"]


def _table(spark, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n).round(1), rng.integers(0, 40, n).astype(float), rng.integers(0, 4, n).astype(float)
    y = (a + 0.05 * b + rng.normal(scale=0.7, size=n) > 1).astype(int)
    z = 3 * a + c + rng.normal(scale=0.3, size=n).round(2)
    rows = [(f"r{i}", float(a[i]), float(b[i]), float(c[i]), int(y[i]), float(z[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, a double, b double, c double, y int, z double").repartition(3).cache()


@pytest.fixture
def on_cells(monkeypatch):
    def switch(on):
        monkeypatch.setattr(binned, "BINNED_ROWS", 0 if on else 1 << 60)
        monkeypatch.setattr(binned, "ROWS_PER_CELL", 0)
    return switch


def _predicted(model, df, col):
    return np.array([r[0] if col == "prediction" else r[0][1] for r in model.transform(df).orderBy("id").select(col).collect()])


@pytest.mark.parametrize("task, y", [("classification", "y"), ("regression", "z")])
@pytest.mark.parametrize("name", ["tree", "gbm"])
def test_cells_give_the_models_of_the_rows(spark, on_cells, task, y, name):
    """Equal predictions; the cells path is the one taken."""
    df, found, col = _table(spark), [], "probability" if task == "classification" else "prediction"
    for on in (False, True):
        on_cells(on)
        model = train.fit(df, name, task, FEATURES, y=y, params={"maxIter": 3} if name == "gbm" else None)
        assert (type(model.stages[0]).__name__ == "Bucketizer") is on
        found.append(_predicted(model, df, col))
    assert found[0] == pytest.approx(found[1], abs=1e-9)


@pytest.mark.parametrize("task, y", [("classification", "y"), ("regression", "z")])
def test_forest_on_cells(spark, on_cells, task, y, tmp_path):
    """As good as a forest over rows, the same in any layout, and saved like any model."""
    df, found, col = _table(spark), [], "probability" if task == "classification" else "prediction"
    for on, some in ((False, df), (True, df), (True, df.repartition(7))):
        on_cells(on)
        model = train.fit(some, "forest", task, FEATURES, y=y, params={"featureSubsetStrategy": "all", "n_estimators": 12})     # without the chance of a node's features
        assert model.stages[-1].getNumTrees == 12
        found.append(_predicted(model, df, col))
    actual = np.array([r[0] for r in df.orderBy("id").select(y).collect()], dtype=float)
    error = [((p - actual) ** 2).mean() for p in found]
    assert error[1] == pytest.approx(error[0], rel=0.08) and found[1] == pytest.approx(found[2], abs=1e-9)
    train.save_model(model, str(tmp_path / "m"), "forest")
    assert _predicted(train.load_model(str(tmp_path / "m")), df, col) == pytest.approx(found[2], abs=1e-9)


def test_draws_are_those_of_rows(spark):
    """A cell of n rows is drawn about n times, its drawn labels spread as a bootstrap of its rows."""
    rows = spark.createDataFrame([(float(i % 2), float(i % 10), 1.0) for i in range(4000)], "b0 double, label double, _n double")
    cells = rows.groupBy("b0").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("_n"))
    drawn = binned.draw_rows(rows, cells, ["b0"], False, 200, 0).collect()
    w = np.stack([np.sum([np.frombuffer(r["w"]) for r in drawn if r["tree"] == t], axis=0) for t in range(200)])
    s = np.stack([np.sum([np.frombuffer(r["s"]) for r in drawn if r["tree"] == t], axis=0) for t in range(200)])
    assert w.sum(axis=1).mean() == pytest.approx(4000, rel=0.01) and w.sum(axis=1).var() == pytest.approx(4000, rel=0.35)
    mean = s.sum(axis=1) / w.sum(axis=1)
    assert mean.std() == pytest.approx(np.sqrt(8.25 / 4000), rel=0.25)


def test_all_models_share_cells_and_scoring(spark, on_cells):
    """One table of cells for the trees, test rows read once; the scores of each model alone."""
    on_cells(True)
    df = _table(spark)
    models, scored = train.train_models(df, df, ["tree", "gbm", "logistic"], "classification", FEATURES, params={"gbm": {"maxIter": 2}})
    plan = scored._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
    assert scored.columns == ["id", "y", "yh", "p", "probs", "model"]
    for name, model in models.items():
        mine = np.array([r["p"] for r in scored.where(F.col("model") == name).orderBy("id").collect()])
        assert mine == pytest.approx(_predicted(model, df, "probability"))
    assert not [c for c in scored.columns if c.startswith("_bin")]


def test_learning_curve_on_cells(spark, on_cells):
    """fits and scores over counted cells give the curve of the rows."""
    from probity.operators import overfit
    df, curves = _table(spark).withColumn("label", F.col("y").cast("double")), []
    for on in (False, True):
        on_cells(on)
        est = train.make_pipeline("tree", "classification", FEATURES)
        curves.append([tuple(r) for r in overfit.learning_curve(df, est, sizes=(0.5, 1.0), folds=2).collect()])
    assert len(curves[0]) == 2
    for a, b in zip(*curves):
        assert a == pytest.approx(b)


def test_refused_rows_still_raise(spark, on_cells):
    on_cells(True)
    df = _table(spark, 300).withColumn("a", F.when(F.col("b") != 3, F.col("a")))
    with pytest.raises(Exception):
        train.fit(df, "tree", "classification", FEATURES)
