"""Column names with dots and spaces (FIXTURES §4; the card-default target has dots)."""

import math

from pyspark.sql import functions as F

from probity.operators import clean, fairness, metrics, profile, resilience, select


def _df(spark):
    rows = [(f"r{i}", float(i % 7), float((i * 3) % 5), i % 2, int((i % 7) > 3), (i % 10) / 10.0,
             "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "`row id` string, `pay.amt 1` double, `bill amt` double, "
                                       "`default.payment.next.month` int, `pred.label` int, `p.score` double, "
                                       "`sex.code` string")


def test_odd_names_profile_select_clean(spark):
    df = _df(spark)
    feats = ["pay.amt 1", "bill amt"]
    s = {r["feature"]: r for r in profile.numeric_summary(df, feats).collect()}
    assert set(s) == set(feats)
    assert profile.missing_report(df).count() == len(df.columns)
    assert profile.categorical_summary(df, ["sex.code"]).first()["unique"] == 2
    assert profile.pearson_matrix(df, feats).count() == 1
    r = select.pearson_target(df, "default.payment.next.month", feats).collect()
    assert len(r) == 2
    sp = select.spearman_target(df, "default.payment.next.month", feats).collect()
    assert len(sp) == 2
    imp = clean.impute(df, feats, "median")
    assert imp.columns == df.columns
    z = clean.standardize(df, feats)
    assert abs(z.agg(F.avg(F.col("`pay.amt 1`"))).first()[0]) < 1e-12


def test_odd_names_metrics_fairness_resilience(spark):
    df = _df(spark)
    y, yh, p = "default.payment.next.month", "pred.label", "p.score"
    assert metrics.binary_metrics(df, y, yh, p).count() == 1
    assert metrics.auc(df, y, p).first()["auc"] is not None
    fr = fairness.fairness_ratios(df, ["sex.code", "pay.amt 1"], y, yh).collect()
    assert {r["feature"] for r in fr} <= {"sex.code", "pay.amt 1"}
    res = resilience.residual_column(df, y=y, p=p)
    w = resilience.worst_samples(res, 0.5, id_col="row id")
    assert w.count() == 30
    both = df.withColumn("side", F.when(F.col("`bill amt`") < 2, "expected").otherwise("actual"))
    assert resilience.psi(both, ["pay.amt 1"]).count() == 1


def test_odd_names_rescoring_operators(spark):
    from probity.operators import explain, overfit, robust
    from probity.operators.scoring import Scorer
    df = _df(spark)
    y = "default.payment.next.month"
    sc = Scorer.from_columns(p=F.col("`pay.amt 1`") / F.lit(7.0))
    feats = ["pay.amt 1", "bill amt"]
    base = df.select("`row id`", "`pay.amt 1`", "`bill amt`", F.col(f"`{y}`"))
    assert explain.permutation_importance(base, sc, feats, "ACC", y=y, id_col="row id", repeats=2).count() == 4
    assert overfit.noise_sensitivity(base, sc, feats, y=y, id_col="row id").count() == 2
    assert robust.robustness_runs(base, sc, feats, y=y, id_col="row id", metric="ACC", sizes=(0.0, 0.2),
                                  iterations=2).count() == 4
    assert explain.partial_dependence(base, sc, "bill amt").count() == 5
    phi = explain.linear_shap(base, {"pay.amt 1": 1.0, "bill amt": 0.5}, id_col="row id")
    assert phi.count() == 120
    assert explain.sampled_shap(base, sc, feats, base.select("`pay.amt 1`", "`bill amt`"), id_col="row id",
                                n_samples=2).count() == 120
