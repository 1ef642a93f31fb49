"""Conformal prediction and calibration.

The reference's p-value compares every test score with every calibration score
(O(n_cal · n_test)).  Here calibration and test scores are unioned and a running
count of calibration rows is taken in descending score order (``running_sums``):
O(n log n), no theta join, no single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.binning import bin_index, linspace_edges, unit_edges
from probity.functions.util import as_col, safe_div
from probity.plans.ordering import running_sums
from probity.plans.quantiles import exact_quantiles


def _probs(probs=None, p=None):
    if probs is not None:
        return as_col(probs)
    pc = as_col(p).cast("double")
    return F.array(F.lit(1.0) - pc, pc)


def calibration_strangeness(df: DataFrame, y="y", probs=None, p=None, out="strangeness") -> DataFrame:
    """1 − p[true class]."""
    arr = _probs(probs, p)
    return df.withColumn(out, F.lit(1.0) - F.element_at(arr, as_col(y).cast("int") + 1))


def test_strangeness(df: DataFrame, probs=None, p=None, out="strangeness") -> DataFrame:
    """1 − max class probability (R2)."""
    return df.withColumn(out, F.lit(1.0) - F.array_max(_probs(probs, p)))


def cutoff(cal: DataFrame, score="strangeness", alpha: float = 0.95) -> DataFrame:
    """One row: the linear percentile of calibration scores at ``alpha``."""
    q = exact_quantiles(cal, score, [alpha])
    return q.select(F.col("quantile").alias("cutoff"))


def conformal_flags(test: DataFrame, cut: DataFrame, score="strangeness") -> DataFrame:
    """Per test row: conformal flag (score ≤ cut-off) (R4).  ``cut`` has one row."""
    return test.crossJoin(F.broadcast(cut)).withColumn("conformal", as_col(score) <= F.col("cutoff"))


def conformal_summary(cal: DataFrame, test: DataFrame, score="strangeness", alpha: float = 0.95) -> DataFrame:
    """Cut-off and the conformal / non-conformal shares of the test set."""
    flags = conformal_flags(test, cutoff(cal, score, alpha), score)
    return flags.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.col("conformal").cast("double")).alias("share_conformal")).select(
        F.lit(float(alpha)).alias("alpha"), "cutoff", "n_test", "share_conformal",
        (F.lit(1.0) - F.col("share_conformal")).alias("share_non_conformal"))


def conformal_pvalues(cal: DataFrame, test: DataFrame, score="strangeness", id_col="id") -> DataFrame:
    """Per test row: share of calibration scores ≥ its score (R5), O(n log n)."""
    c = cal.select(as_col(score).cast("double").alias("s"), F.lit(1).cast("bigint").alias("w"))
    t = test.select(as_col(score).cast("double").alias("s"), F.lit(0).cast("bigint").alias("w"))
    rs = running_sums(c.unionByName(t), "s", ["w"], descending=True)
    n_cal = cal.agg(F.count(F.lit(1)).alias("_ncal"))
    table = rs.crossJoin(F.broadcast(n_cal)).select(
        F.col("s").alias("_s"), safe_div(F.col("cum_w"), F.col("_ncal")).alias("p_value"))
    tt = test.select(as_col(id_col).alias("id"), (as_col(score).cast("double") + F.lit(0.0)).alias("_s"))
    return tt.join(table, "_s", "inner").select("id", F.col("_s").alias("strangeness"), "p_value")


def histogram_table(df: DataFrame, col: str, bins: int, density: bool = False) -> DataFrame:
    """``np.histogram(x, bins)`` over [min, max], empty bins kept; density optional."""
    v = as_col(col).cast("double")
    stats = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_n")).withColumn(
        "_e", linspace_edges("_lo", "_hi", bins))
    counted = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).crossJoin(
        F.broadcast(stats.select("_e"))).select(bin_index("_v", "_e", bins, "left").alias("bin")) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = stats.where(F.col("_n") > 0).select("_e", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counted, "bin", "left").select(
        "bin", F.element_at("_e", F.col("bin") + 1).alias("lower"), F.element_at("_e", F.col("bin") + 2).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "_n")
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * (F.col("upper") - F.col("lower"))))
    return out.drop("_n")


def sorted_positions(df: DataFrame, score="strangeness", set_col="set") -> DataFrame:
    """Sorted scores against normalised position i/n, per set, one row per distinct
    score: (set, strangeness, position of its first row, rows at that score) (R8)."""
    base = df.select(as_col(set_col).alias("set"), as_col(score).cast("double").alias("strangeness"),
                     F.lit(1).cast("bigint").alias("cnt"))
    rs = running_sums(base, "strangeness", ["cnt"], ["set"])
    n = base.groupBy("set").agg(F.count(F.lit(1)).alias("_n"))
    return rs.join(F.broadcast(n), "set").select(
        "set", "strangeness", ((F.col("cum_cnt") - F.col("cnt")) / F.col("_n")).alias("position"),
        F.col("cnt").alias("n_at"))


def calibration_curve(df: DataFrame, y="y", p="p", n_bins: int = 10, by=()) -> DataFrame:
    """10 equal bins on [0, 1], value on an edge → lower bin, empty bins dropped:
    mean predicted probability and fraction of positives per bin (R9)."""
    by = [by] if isinstance(by, str) else list(by)
    e = unit_edges(n_bins)
    b = bin_index(as_col(p).cast("double"), e, n_bins, side="right", include_lowest=True)
    return df.select(*by, b.alias("bin"), as_col(p).cast("double").alias("_p"), as_col(y).cast("double").alias("_y")) \
             .where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
                 F.count(F.lit(1)).alias("count"), F.avg("_p").alias("mean_predicted"),
                 F.avg("_y").alias("fraction_positive"))


def abs_residuals(df: DataFrame, y="y", yh="yh", out="abs_residual") -> DataFrame:
    """|y − yh| (R10)."""
    return df.withColumn(out, F.abs(as_col(y).cast("double") - as_col(yh).cast("double")))


def conformal_regression(cal: DataFrame, test: DataFrame, y="y", yh="yh", alpha: float = 0.9,
                         id_col="id") -> tuple[DataFrame, DataFrame]:
    """Interval yh ± cut-off per test row and the within/outside shares."""
    c = abs_residuals(cal, y, yh)
    t = abs_residuals(test, y, yh)
    cut = cutoff(c, "abs_residual", alpha)
    rows = t.crossJoin(F.broadcast(cut)).select(
        as_col(id_col).alias("id"), as_col(yh).cast("double").alias("predicted"),
        (as_col(yh) - F.col("cutoff")).alias("lower"), (as_col(yh) + F.col("cutoff")).alias("upper"),
        as_col(y).cast("double").alias("actual"), (F.col("abs_residual") <= F.col("cutoff")).alias("within"))
    summary = rows.groupBy().agg(F.count(F.lit(1)).alias("n_test"),
                                 (F.avg(F.col("within").cast("double")) * F.lit(100.0)).alias("pct_within")) \
        .crossJoin(cut).select(F.lit(float(alpha)).alias("alpha"), "cutoff", "n_test", "pct_within",
                               (F.lit(100.0) - F.col("pct_within")).alias("pct_outside"))
    return rows, summary


def residual_histogram(df: DataFrame, y="y", yh="yh", bins: int = 30) -> DataFrame:
    """Histogram of y − yh with 30 bins."""
    r = df.select((as_col(y).cast("double") - as_col(yh).cast("double")).alias("residual"))
    return histogram_table(r, "residual", bins)
