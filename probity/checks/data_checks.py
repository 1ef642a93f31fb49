"""Checks for profiling, cleaning, splits and feature selection (P, C, D, E, V3-V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import clean, profile, select, split
from probity.registry import register, rounded
from probity.sources import fixtures as fx
from probity.sources.fixtures import H, with_views

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, d):
    li = fx.read(spark, d, "lineitem")
    return li.select(*[(F.col(c) + F.lit(0.0)).alias(c) if c in ("l_discount", "l_tax") else F.col(c)
                       for c in li.columns])


_SCHEMA_ROWS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("schema_info", " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM lineitem"
    for c, t in _SCHEMA_ROWS))
def schema_info(spark, d):
    return rounded(profile.schema_info(fx.read(spark, d, "lineitem")))


@register("numeric_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
        round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem"""
    for c in LI_NUM))
def numeric_summary(spark, d):
    return rounded(profile.numeric_summary(_li(spark, d), LI_NUM))


_PART_CAT = ["p_brand", "p_type", "p_name"]


@register("categorical_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS unique,
        arg_min(v, (-cnt, v)) AS top, max(cnt) AS freq
        FROM (SELECT {c} AS v, count(*) AS cnt FROM part GROUP BY {c}) t"""
    for c in _PART_CAT))
def categorical_summary(spark, d):
    return rounded(profile.categorical_summary(fx.read(spark, d, "part"), _PART_CAT))


_NUL_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


@register("missing_report", with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
        round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS missing_rate,
        CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 0 AS BIGINT) AS any_missing,
        CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*) > 0.2 AS BIGINT) AS high_missing
        FROM nul""" for c in _NUL_COLS), "nul"))
def missing_report(spark, d):
    return rounded(profile.missing_report(fx.nul(spark, d), _NUL_COLS))


_HIST = """
st AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
ed AS (SELECT lo, hi, [i * ((hi - lo) / 10.0) + lo FOR i IN range(10)] || [hi] AS e FROM st),
b AS (SELECT len(list_filter(e[2:10], lambda x: x <= l_extendedprice)) AS bin
      FROM lineitem CROSS JOIN ed),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
"""


@register("histogram", with_views("""
SELECT 'l_extendedprice' AS feature, g.bin, round(e[g.bin + 1], 6) AS lower, round(e[g.bin + 2], 6) AS upper,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT unnest(range(10)) AS bin) g CROSS JOIN ed LEFT JOIN c ON g.bin = c.bin
""", ctes=_HIST))
def histogram(spark, d):
    return rounded(profile.histogram(fx.read(spark, d, "lineitem"), "l_extendedprice", 10))


@register("category_counts", "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1")
def category_counts(spark, d):
    return rounded(profile.category_counts(fx.read(spark, d, "customer"), "c_mktsegment"))


@register("binned_pairs", """
WITH st AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl,
                   max(l_extendedprice) AS yh FROM lineitem),
ed AS (SELECT [i * ((xh - xl) / 10.0) + xl FOR i IN range(10)] || [xh] AS ex,
              [i * ((yh - yl) / 10.0) + yl FOR i IN range(10)] || [yh] AS ey FROM st)
SELECT len(list_filter(ex[2:10], lambda v: v <= l_quantity)) AS bin_x,
       len(list_filter(ey[2:10], lambda v: v <= l_extendedprice)) AS bin_y, count(*) AS count
FROM lineitem CROSS JOIN ed GROUP BY 1, 2
""")
def binned_pairs(spark, d):
    return rounded(profile.binned_pairs(fx.read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


_PAIRS = [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]]


@register("pearson_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a, b in _PAIRS))
def pearson_matrix(spark, d):
    return rounded(profile.pearson_matrix(_li(spark, d), LI_NUM))


@register("correlated_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a, b in _PAIRS) + ") t WHERE abs(r) > 0.8")
def correlated_pairs(spark, d):
    return rounded(profile.correlated_pairs(_li(spark, d), LI_NUM, 0.8))


@register("to_number", """
SELECT p_partkey, TRY_CAST(CASE WHEN p_size < 10 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size_num
FROM part""")
def to_number(spark, d):
    p = fx.read(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") < 10, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
        .alias("size_num"))
    return rounded(profile.to_number(p, "size_num"))


@register("outlier_fences", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
        round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
        (SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
          AS n_outliers
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) t"""
    for c in LI_NUM))
def outlier_fences(spark, d):
    return rounded(profile.outlier_fences(_li(spark, d), LI_NUM))


# ---------------------------------------------------------------- cleaning

_IMP_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@register("impute_mean", with_views(f"""
SELECT id, {", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM nul)), 6) AS {c}" for c in _IMP_NUM)}
FROM nul""", "nul"))
def impute_mean(spark, d):
    df = fx.nul(spark, d).select("id", *_IMP_NUM)
    return rounded(clean.impute(df, _IMP_NUM, "mean"))


@register("impute_median", with_views(f"""
SELECT id, {", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM nul)), 6) AS {c}"
                      for c in _IMP_NUM)}
FROM nul""", "nul"))
def impute_median(spark, d):
    df = fx.nul(spark, d).select("id", *_IMP_NUM)
    return rounded(clean.impute(df, _IMP_NUM, "median"))


@register("impute_mode", with_views("""
SELECT id, coalesce(l_returnflag, (SELECT arg_min(v, (-cnt, v)) FROM
         (SELECT l_returnflag AS v, count(*) AS cnt FROM nul WHERE l_returnflag IS NOT NULL GROUP BY 1) t))
         AS l_returnflag,
       round(coalesce(l_quantity, (SELECT arg_min(v, (-cnt, v)) FROM
         (SELECT l_quantity AS v, count(*) AS cnt FROM nul WHERE l_quantity IS NOT NULL GROUP BY 1) t)), 6)
         AS l_quantity
FROM nul""", "nul"))
def impute_mode(spark, d):
    df = fx.nul(spark, d).select("id", "l_returnflag", "l_quantity")
    return rounded(clean.impute(df, ["l_returnflag", "l_quantity"], "most_frequent"))


@register("impute_constant", with_views("""
SELECT id, coalesce(l_returnflag, 'missing_value') AS l_returnflag, round(coalesce(l_discount, 0.0), 6)
       AS l_discount FROM nul""", "nul"))
def impute_constant(spark, d):
    df = fx.nul(spark, d).select("id", "l_returnflag", "l_discount")
    return rounded(clean.impute(df, ["l_returnflag", "l_discount"], "constant"))


@register("standardize", with_views("""
SELECT id, """ + ", ".join(
    f"round(CASE WHEN (SELECT stddev_pop({c}) FROM reg) = 0 THEN 0.0 ELSE "
    f"({c} - (SELECT avg({c}) FROM reg)) / (SELECT stddev_pop({c}) FROM reg) END, 6) AS {c}"
    for c in fx.FEATURES) + " FROM reg", "reg"))
def standardize(spark, d):
    df = fx.reg(spark, d).select("id", *fx.FEATURES)
    return rounded(clean.standardize(df, fx.FEATURES))


@register("min_max_scale", with_views("""
SELECT id, """ + ", ".join(
    f"round(CASE WHEN (SELECT max({c}) - min({c}) FROM reg) = 0 THEN 0.0 ELSE "
    f"({c} - (SELECT min({c}) FROM reg)) / (SELECT max({c}) - min({c}) FROM reg) END, 6) AS {c}"
    for c in fx.FEATURES) + " FROM reg", "reg"))
def min_max_scale(spark, d):
    df = fx.reg(spark, d).select("id", *fx.FEATURES)
    return rounded(clean.min_max_scale(df, fx.FEATURES))


@register("drop_missing_rows", with_views(
    "SELECT id FROM nul WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL "
    "AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL", "nul"))
def drop_missing_rows(spark, d):
    return clean.drop_missing_rows(fx.nul(spark, d)).select("id")


@register("sample_rows", with_views(
    f"SELECT id, split FROM clf ORDER BY {H('id', 'sample:42')}, id LIMIT 1000", "clf"))
def sample_rows(spark, d):
    return clean.sample_rows(fx.clf(spark, d).select("id", "split"), 1000, "id", 42)


@register("label_encode", """
SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand_code FROM part""")
def label_encode(spark, d):
    p = fx.read(spark, d, "part").select("p_partkey", "p_brand")
    return rounded(clean.label_encode(p, ["p_brand"], suffix="_code"))


@register("one_hot", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS seg_code,
       CAST((SELECT count(DISTINCT c_mktsegment) FROM customer) + 2 AS BIGINT) AS vec_size,
       round(1.0 + c_acctbal, 6) AS vec_sum, round(c_acctbal, 6) AS acctbal FROM customer""")
def one_hot(spark, d):
    c = fx.read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = clean.one_hot(c, ["c_mktsegment"], ["c_acctbal"])
    arr = F.col("features_array")
    return rounded(out.select(
        "c_custkey",
        (F.array_position(F.slice(arr, 1, F.size(arr) - 1), 1.0) - 1).alias("seg_code"),
        F.size(arr).alias("vec_size"),
        F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("vec_sum"),
        F.element_at(arr, -1).alias("acctbal")))


# ------------------------------------------------------------------- splits

@register("train_test_split", with_views(
    f"SELECT id, CASE WHEN {H('id', 'tt:0')} < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM clf",
    "clf"))
def train_test_split(spark, d):
    return split.train_test_split(fx.clf(spark, d).select("id"), "id", 0.2, 0)


@register("train_val_test_split", with_views(f"""
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN {H('id', 'tt:42')} < 0.2::DOUBLE THEN 'test'
              WHEN {H('id', 'val:42')} < 0.25::DOUBLE THEN 'val' ELSE 'train' END AS split FROM clf) t
GROUP BY split""", "clf"))
def train_val_test_split(spark, d):
    s = split.train_val_test_split(fx.clf(spark, d).select("id"), "id", 0.2, 0.25, 42)
    return rounded(split.split_counts(s))


@register("diagnosis_split", with_views(f"""
SELECT id, CASE WHEN {H('id', 'diag:42')} < 0.6::DOUBLE THEN 'train'
                WHEN {H('id', 'diag:42')} < 0.8::DOUBLE THEN 'cal' ELSE 'test' END AS split FROM clf""", "clf"))
def diagnosis_split(spark, d):
    return split.diagnosis_split(fx.clf(spark, d).select("id"), "id")


@register("fold_assign", with_views(f"""
SELECT fold, count(*) AS n FROM (
  SELECT CAST(least(floor({H('id', 'fold:0')} * 3), 2) AS BIGINT) AS fold FROM clf) t GROUP BY fold""", "clf"))
def fold_assign(spark, d):
    f = split.assign_folds(fx.clf(spark, d).select("id"), "id", 3, 0)
    return rounded(f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")))


@register("class_summary", with_views("""
SELECT 'clf' AS fixture, count(DISTINCT y) AS n_classes,
       CASE WHEN count(DISTINCT y) > 2 THEN 'macro' ELSE 'binary' END AS average FROM clf
UNION ALL
SELECT 'multi', count(DISTINCT y), CASE WHEN count(DISTINCT y) > 2 THEN 'macro' ELSE 'binary' END FROM multi
""", "clf", "multi"))
def class_summary(spark, d):
    a = split.class_summary(fx.clf(spark, d)).withColumn("fixture", F.lit("clf"))
    b = split.class_summary(fx.multi(spark, d)).withColumn("fixture", F.lit("multi"))
    return rounded(a.unionByName(b))


# -------------------------------------------------------------- selection

_SEL = ["f1", "f3", "f4"]


@register("pearson_target", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS r, round(abs(corr({c}, y)), 6) AS abs_r, "
    f"CAST(abs(corr({c}, y)) >= 0.1 OR corr({c}, y) IS NULL AS BIGINT) AS keep FROM reg" for c in _SEL), "reg"))
def pearson_target(spark, d):
    return rounded(select.pearson_target(fx.reg(spark, d), "y", _SEL, 0.1))


_RANKS = """
lg AS (SELECT 'f1' AS feature, f1 AS value, y FROM reg UNION ALL SELECT 'f3', f3, y FROM reg
       UNION ALL SELECT 'f4', f4, y FROM reg),
rk AS (SELECT feature,
              rank() OVER (PARTITION BY feature ORDER BY value)
                + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY feature ORDER BY y)
                + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
       FROM lg)
"""


@register("spearman_target", with_views("""
SELECT feature, round(corr(rx, ry), 6) AS r, round(abs(corr(rx, ry)), 6) AS abs_r,
       CAST(abs(corr(rx, ry)) >= 0.1 OR corr(rx, ry) IS NULL AS BIGINT) AS keep FROM rk GROUP BY feature
""", "reg", ctes=_RANKS))
def spearman_target(spark, d):
    return rounded(select.spearman_target(fx.reg(spark, d), "y", _SEL, 0.1))


@register("removal_report", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, y), 6) AS score, "
    f"CASE WHEN NOT (corr({c}, y) IS NOT NULL AND abs(corr({c}, y)) < 0.1) THEN 'kept' "
    f"WHEN '{c}' IN ('f1', 'f3') THEN 'removed' ELSE 'absent' END AS status FROM reg" for c in _SEL), "reg"))
def removal_report(spark, d):
    scores = select.pearson_target(fx.reg(spark, d), "y", _SEL)
    return rounded(select.removal_report(scores, ["f1", "f3"], "r", 0.1))


_SP_RANKS = """
lg AS (SELECT id, 'f1' AS feature, f1 AS value FROM reg UNION ALL SELECT id, 'f2', f2 FROM reg
       UNION ALL SELECT id, 'f3', f3 FROM reg UNION ALL SELECT id, 'f4', f4 FROM reg),
rk AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value)
              + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM lg),
wd AS (SELECT id, max(CASE WHEN feature = 'f1' THEN r END) AS f1, max(CASE WHEN feature = 'f2' THEN r END) AS f2,
              max(CASE WHEN feature = 'f3' THEN r END) AS f3, max(CASE WHEN feature = 'f4' THEN r END) AS f4
       FROM rk GROUP BY id)
"""


@register("spearman_matrix", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM wd"
    for i, a in enumerate(fx.FEATURES) for b in fx.FEATURES[i + 1:]), "reg", ctes=_SP_RANKS))
def spearman_matrix(spark, d):
    return rounded(profile.spearman_matrix(fx.reg(spark, d), fx.FEATURES, "id"))
