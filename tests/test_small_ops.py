"""Schema-level and small operators."""

import pytest
from pyspark.sql import functions as F

from probity.operators import clean, profile, select
from probity.sources import files


def test_type_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    assert profile.select_types(df, "numeric") == ["i", "d"]
    assert profile.select_types(df, "categorical") == ["s", "b"]
    assert dict(profile.to_category(df, "i").dtypes)["i"] == "string"
    assert clean.feature_columns(df, "d", exclude=("b",)) == ["i", "s"]
    with pytest.raises(ValueError):
        clean.impute(df, ["s"], "mean")           # C5: mean is not allowed for strings


def test_preview_and_write(spark, tmp_path):
    df = spark.range(50)
    assert files.preview(df, 10).count() == 10
    files.write_result(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_selection_remove_revert_and_rank(spark):
    rows = [(float(i), float(i % 3), float(-i), float(i * i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    scores = select.pearson_target(df, "y", ["a", "b", "c"], threshold=0.5)
    rep = select.removal_report(scores, ["a", "b"], "r", 0.5)
    status = {r["feature"]: r["status"] for r in rep.collect()}
    assert status["b"] == "kept" and status["a"] == "removed"
    reduced = select.remove_features(df, rep)
    assert "a" not in reduced.columns and "a" in df.columns          # E8: the old frame is the revert
    imp = spark.createDataFrame([("a", 0.1), ("b", -0.2), ("c", 0.3)], "feature string, importance double")
    assert [r["feature"] for r in select.rank_features(imp).collect()] == ["c", "a", "b"]
    assert [r["keep"] for r in select.rethreshold(imp, 0.0).orderBy("feature").collect()] == [True, False, True]
    signed = select.removal_report(imp.withColumnRenamed("importance", "r"), ["a", "b", "c"], "r", 0.0, signed=True)
    assert {r["feature"] for r in signed.where("status = 'removed'").collect()} == {"b"}


def test_spread_for_fanout(spark):
    from probity.plans.reshape import spread_for_fanout
    par = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    spread = spread_for_fanout(one, "id")
    assert spread.rdd.getNumPartitions() == par and spread.count() == 100
    many = spark.range(100).repartition(par + 3)
    assert spread_for_fanout(many, "id").rdd.getNumPartitions() == par + 3   # left alone
