"""Data profiling.

All column-wise statistics are computed in one pass over the data: either a single
``agg`` with one expression per column, or a long (feature, value) reshape grouped
by feature.  Nothing but schema-sized results ever reaches the driver.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.binning import bin_index, linspace_edges
from probity.functions.util import as_col, categorical_columns, count_if, numeric_columns, quote, safe_div
from probity.plans.quantiles import quantile_table
from probity.plans.reshape import bounded_broadcast, to_long
from probity.session import cut_lineage


def schema_info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, n_rows) per column, one aggregation pass."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(as_col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    kinds = F.create_map(*[x for i, f in enumerate(df.schema.fields)
                           for x in (F.lit(f"_c{i}"), F.lit(f.dataType.simpleString()))])
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"_c{i}"), F.lit(c))])
    long = agg.unpivot(["_n"], [f"_c{i}" for i in range(len(cols))], "_k", "non_null")
    return long.select(names[F.col("_k")].alias("column"), kinds[F.col("_k")].alias("dtype"),
                       F.col("non_null").cast("bigint").alias("non_null"),
                       F.col("_n").cast("bigint").alias("n_rows"))


def numeric_summary(df: DataFrame, cols=None, method: str = "exact") -> DataFrame:
    """count, mean, std (n−1), min, 25/50/75 % (linear), max per numeric column."""
    cols = cols or numeric_columns(df)
    long = to_long(df, [], cols).where(F.col("value").isNotNull())
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantile_table(long, "value", [0.25, 0.5, 0.75], ["feature"], method=method, max_groups=len(cols))
    qw = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("q") == v, F.col("quantile"))).alias(n)
          for v, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return basic.join(bounded_broadcast(qw, len(cols)), "feature", "left").select(
        "feature", F.col("count").cast("bigint").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def categorical_summary(df: DataFrame, cols=None) -> DataFrame:
    """count, unique, top (most frequent; tie → smallest) and freq per column."""
    cols = cols or categorical_columns(df)
    long = to_long(df, [], cols, cast="string").where(F.col("value").isNotNull())
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return vc.groupBy("feature").agg(
        F.sum("cnt").cast("bigint").alias("count"),
        F.count(F.lit(1)).cast("bigint").alias("unique"),
        F.min_by("value", F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v"))).alias("top"),
        F.max("cnt").cast("bigint").alias("freq"))


def missing_report(df: DataFrame, cols=None, high: float = 0.2) -> DataFrame:
    """Missing count, rate, any-missing flag and > ``high`` hint per column."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[count_if(as_col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(cols)])
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"_c{i}"), F.lit(c))])
    long = agg.unpivot(["_n"], [f"_c{i}" for i in range(len(cols))], "_k", "n_missing")
    rate = safe_div(F.col("n_missing"), F.col("_n"))
    return long.select(names[F.col("_k")].alias("column"), F.col("n_missing").cast("bigint").alias("n_missing"),
                       rate.alias("missing_rate"), (F.col("n_missing") > 0).alias("any_missing"),
                       (rate > F.lit(high)).alias("high_missing"))


def histogram(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max], numpy rule, empty bins kept."""
    v = as_col(col).cast("double")
    stats = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).withColumn(
        "_e", linspace_edges("_lo", "_hi", n))
    counted = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).crossJoin(F.broadcast(stats.select("_e"))) \
                .select(bin_index("_v", "_e", n, "left").alias("bin")).groupBy("bin").agg(
                    F.count(F.lit(1)).alias("count"))
    grid = stats.where(F.col("_lo").isNotNull()).select(
        "_e", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return grid.join(counted, "bin", "left").select(
        F.lit(col).alias("feature"), "bin", F.element_at("_e", F.col("bin") + 1).alias("lower"),
        F.element_at("_e", F.col("bin") + 2).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Row count per category, nulls included as their own group."""
    return df.groupBy(as_col(col).alias("value")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def binned_pairs(df: DataFrame, x: str, y: str, nx: int = 10, ny: int = 10) -> DataFrame:
    """2-D equal-width binned counts for a pair of numeric columns (P8, re-aimed scatter)."""
    xv, yv = as_col(x).cast("double"), as_col(y).cast("double")
    stats = df.agg(F.min(xv).alias("_xl"), F.max(xv).alias("_xh"), F.min(yv).alias("_yl"),
                   F.max(yv).alias("_yh")).select(linspace_edges("_xl", "_xh", nx).alias("_ex"),
                                                  linspace_edges("_yl", "_yh", ny).alias("_ey"))
    d = df.select(xv.alias("_x"), yv.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    b = d.crossJoin(F.broadcast(stats)).select(bin_index("_x", "_ex", nx).alias("bin_x"),
                                                bin_index("_y", "_ey", ny).alias("bin_y"))
    return b.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def pearson_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pairwise-complete Pearson r for every pair a < b (P9), null for a constant column.

    One pass: each row goes out once per pair and meets the stable ``covar_pop`` /
    ``var_pop`` aggregates on the map side, so one row per pair and task is shuffled.
    The rule and the plan are the same at every width.
    """
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        raise ValueError("pearson_matrix needs at least two numeric columns")
    values = df.select(F.array(*[as_col(c).cast("double") for c in cols]).alias("_v"))
    first = values.select("_v", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 2))).alias("_i"))
    pairs = first.select("_v", "_i", F.explode(F.sequence(F.col("_i") + 1, F.lit(len(cols) - 1))).alias("_j"))
    xa, xb = F.col("_v")[F.col("_i")], F.col("_v")[F.col("_j")]
    both = pairs.select("_i", "_j", xa.alias("_a"), xb.alias("_b")).where("_a is not null and _b is not null")
    agg = both.groupBy("_i", "_j").agg(F.try_divide(F.covar_pop("_a", "_b"), F.sqrt(F.var_pop("_a") * F.var_pop("_b"))).alias("r"))
    names = df.sparkSession.createDataFrame([(i, j, a, cols[j]) for i, a in enumerate(cols) for j in range(i + 1, len(cols))],
                                            "_i int, _j int, feature_a string, feature_b string")
    return names.join(agg, ["_i", "_j"], "left").select("feature_a", "feature_b", "r")


def correlated_pairs(df: DataFrame, cols=None, threshold: float = 0.8) -> DataFrame:
    """Predictor pairs with |r| > threshold (V5)."""
    return pearson_matrix(df, cols).where(F.abs("r") > F.lit(threshold))


def to_number(df: DataFrame, col: str) -> DataFrame:
    """Cast to double; unparsable values become null (P10)."""
    c = as_col(col)
    numeric = isinstance(df.schema[col].dataType, T.NumericType)
    return df.withColumn(col, c.cast("double") if numeric else c.cast("string").try_cast("double"))


def to_category(df: DataFrame, col: str) -> DataFrame:
    """Categorical role: cast to string."""
    return df.withColumn(col, as_col(col).cast("string"))


def select_types(df: DataFrame, kind: str) -> list[str]:
    """Column names of a kind: 'numeric' or 'categorical' (P12)."""
    if kind == "numeric":
        return numeric_columns(df)
    if kind == "categorical":
        return categorical_columns(df)
    raise ValueError(kind)


def clean_names(df: DataFrame) -> DataFrame:
    """Lower-case names, non-alphanumerics to '_', duplicates numbered (V3)."""
    seen: dict[str, int] = {}
    new = []
    for c in df.columns:
        base = re.sub(r"[^0-9a-zA-Z]+", "_", c.strip()).strip("_").lower() or "col"
        k = seen.get(base, 0)
        seen[base] = k + 1
        new.append(base if k == 0 else f"{base}_{k}")
    return df.select(*[F.col(quote(c)).alias(n) for c, n in zip(df.columns, new)])


def outlier_fences(df: DataFrame, cols=None, k: float = 1.5) -> DataFrame:
    """Quartile fences q1 − k·IQR, q3 + k·IQR and outlier count per column (V7)."""
    cols = cols or numeric_columns(df)
    long = to_long(df, [], cols).where(F.col("value").isNotNull())
    q = quantile_table(long, "value", [0.25, 0.75], ["feature"], max_groups=len(cols)).groupBy("feature").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lower", F.col("q1") - F.lit(k) * F.col("iqr")) \
         .withColumn("upper", F.col("q3") + F.lit(k) * F.col("iqr"))
    j = long.join(bounded_broadcast(q, len(cols)), "feature")
    n_out = j.groupBy("feature").agg(
        count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))
    return q.join(n_out, "feature", "left").select("feature", "q1", "q3", "iqr", "lower", "upper",
                                                   F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))


RANKS_BROADCAST = 1 << 17     # distinct values of a column whose table of ranks goes to every task
ROWS_A_TASK = 1 << 19         # rows that one task brings together by id


def spearman_matrix(df: DataFrame, cols, id_col: str = "id") -> DataFrame:
    """Spearman rho for every pair a < b: average ranks per column (V6), one row per id, then Pearson of the ranks.

    Ranks are taken over each column's non-null values of all rows; an id on several rows has
    its largest value per column.  Values stay one row an id and meet the tables of ranks
    column by column: a table of up to RANKS_BROADCAST distinct values is broadcast, a longer
    one is joined by value, with the values alone on the other side.  Rows are brought together
    by id in parts of about ROWS_A_TASK, however many there are.
    """
    from probity.plans.ordering import ordered_value, rank_table
    cols = list(cols)
    names = [f"_x{i}" for i in range(len(cols))]
    values = df.select(as_col(id_col).alias("_id"), *[as_col(c).cast("double").alias(x) for c, x in zip(cols, names)])
    long = to_long(values, [], names).where(F.col("value").isNotNull())
    ranks = cut_lineage(rank_table(long, "value", ["feature"], "_rank"))
    distinct = {r["feature"]: r["n"] for r in ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per column
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(values.count() / ROWS_A_TASK))
    wide = values.repartition(parts, "_id").groupBy("_id").agg(*[F.max(x).alias(x) for x in names]).drop("_id")
    for x in names:
        table = ranks.where(F.col("feature") == F.lit(x)).select(F.col("_v").alias("_k"), F.col("_rank").alias("_r"))
        if distinct.get(x, 0) <= RANKS_BROADCAST:
            table = F.broadcast(table)
        wide = wide.withColumn(x, ordered_value(wide, x)).join(table, F.col(x) == F.col("_k"), "left").withColumn(x, F.col("_r")).drop("_k", "_r")
    return pearson_matrix(wide.toDF(*cols), cols)
