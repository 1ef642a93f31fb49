"""Profiling, cleaning and splits on hand-made tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from probity.operators import clean, profile, split
from probity.sources import files


def test_numeric_summary_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=101)
    b = np.r_[np.full(50, 2.0), rng.uniform(size=51)]
    df = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(zip(a, b))],
                               "a double, b double, i int")
    got = {r["feature"]: r for r in profile.numeric_summary(df, ["a", "b", "i"]).collect()}
    for name, x in (("a", a), ("b", b), ("i", np.arange(101.0))):
        r = got[name]
        assert r["count"] == 101
        assert math.isclose(r["mean"], x.mean(), rel_tol=1e-12)
        assert math.isclose(r["std"], x.std(ddof=1), rel_tol=1e-9)
        for q, k in ((25, "p25"), (50, "p50"), (75, "p75")):
            assert math.isclose(r[k], np.percentile(x, q), abs_tol=1e-12)


def test_categorical_summary_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    r = profile.categorical_summary(df, ["s"]).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, "a", 2)


def test_missing_and_histogram(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None), (4.0, "z"), (10.0, "z")], "v double, s string")
    miss = {r["column"]: r for r in profile.missing_report(df).collect()}
    assert miss["v"]["n_missing"] == 1 and miss["s"]["any_missing"] and math.isclose(miss["s"]["missing_rate"], 0.2)
    assert not miss["v"]["high_missing"]
    h = sorted((r["bin"], r["count"]) for r in profile.histogram(df, "v", 3).collect())
    want, _ = np.histogram([1.0, 3.0, 4.0, 10.0], bins=3)
    assert [c for _, c in h] == list(want)


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 6.3, 5.0)], "a double, b double, c double")
    r = {(x["feature_a"], x["feature_b"]): x["r"] for x in profile.pearson_matrix(df).collect()}
    assert r[("a", "c")] is None
    assert math.isclose(r[("a", "b")], np.corrcoef([1, 2, 3], [2, 4.1, 6.3])[0, 1], rel_tol=1e-12)


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (3.0, "b"), (10.0, "a")], "v double, s string")
    mean = [r["v"] for r in clean.impute(df, ["v"], "mean").collect()]
    assert math.isclose(mean[1], (1 + 3 + 3 + 10) / 4)
    med = [r["v"] for r in clean.impute(df, ["v"], "median").collect()]
    assert med[1] == 3.0
    mode = clean.impute(df, ["v", "s"], "most_frequent").collect()
    assert mode[1]["v"] == 3.0 and mode[2]["s"] == "a"      # tie a/b → smallest
    const = clean.impute(df, ["v", "s"], "constant").collect()
    assert const[1]["v"] == 0.0 and const[2]["s"] == "missing_value"


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, c double")
    z = clean.standardize(df, ["a", "c"]).collect()
    a = np.array([1.0, 2.0, 4.0])
    assert all(math.isclose(r["a"], v, abs_tol=1e-12) for r, v in zip(z, (a - a.mean()) / a.std()))
    assert all(r["c"] == 0.0 for r in z)
    mm = clean.min_max_scale(df, ["a", "c"]).collect()
    assert [r["a"] for r in mm] == [0.0, 1 / 3, 1.0] and all(r["c"] == 0.0 for r in mm)


def test_label_encode_and_clean_names(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    codes = [r["s_code"] for r in clean.label_encode(df, ["s"], suffix="_code").collect()]
    assert codes == [1, 0, 2, 0]
    weird = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `A B` int, `a_b` int")
    assert profile.clean_names(weird).columns == ["a_b", "a_b_1", "a_b_2"]


def test_drop_columns_ignores_missing(spark):
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    assert clean.drop_columns(df, ["y", "nope"]).columns == ["x"]


def test_splits_are_partition_independent(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    a = {r["id"]: r["split"] for r in split.train_test_split(df.repartition(1), "id", 0.2).collect()}
    b = {r["id"]: r["split"] for r in split.train_test_split(df.repartition(13), "id", 0.2).collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.16 < share < 0.24
    d = split.diagnosis_split(df, "id").groupBy("split").count().collect()
    assert sum(r["count"] for r in d) == 2000
    folds = {r["fold"] for r in split.assign_folds(df, "id", 3).collect()}
    assert folds == {0, 1, 2}


def test_spec_checks():
    import pytest
    with pytest.raises(ValueError):
        split.ValidationSpec(target="", task="classification")
    with pytest.raises(ValueError):
        split.ValidationSpec(target="y", task="clustering")
    s = split.ValidationSpec(target="y", task="regression")
    assert s.test_ratio == 0.2


def test_sources_csv_and_ids(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,Unnamed: 0\n1.5,x,0\nNaN,y,1\n1.5,x,2\n")
    df = files.load_csv(spark, str(p))
    assert df.where(F.col("a").isNull()).count() == 1
    ided = files.with_row_id(df.drop("Unnamed: 0"))
    ids = [r["id"] for r in ided.collect()]
    assert len(ids) == len(set(ids)) == 3
    spec = files.DatasetSpec("t", "classification", "b", 3, 2, "t", "t.csv", drop=("Unnamed: 0",), sample=1)
    out = files.prepare_preset(files.with_row_id(df), spec)
    assert out.count() == 1 and "Unnamed: 0" not in out.columns
    assert files.catalog(spark).count() == len(files.CATALOG)


def test_pearson_same_rule_at_every_width(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 40))
    x[rng.uniform(size=x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in x],
                               ", ".join(f"{c} double" for c in cols))
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.pearson_matrix(df).collect()}
    assert len(got) == 780
    for (a, b), r in list(got.items())[::13]:
        u, v = x[:, int(a[1:])], x[:, int(b[1:])]
        both = ~(np.isnan(u) | np.isnan(v))
        assert math.isclose(r, np.corrcoef(u[both], v[both])[0, 1], abs_tol=1e-9)
