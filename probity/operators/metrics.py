"""Model-quality metrics as grouped aggregates over a scored table.

Every function takes a scored DataFrame and optional grouping columns ``by`` and
returns one row per group, so the same code scores models, splits, segments,
clusters, perturbation runs and time slices.  Counting metrics are single-pass
conditional aggregates (map-side partial aggregation, tiny shuffle).  Ordered
metrics (AUC, ROC, PR, KS) go through ``running_sums``: pre-aggregated by distinct
score, never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.util import as_col, count_if, safe_div, zero_div
from probity.plans.ordering import distinct_values, running_sums

EPS = 2.220446049250313e-16   # float64 machine epsilon: log-loss clipping


def _by(by):
    return [by] if isinstance(by, str) else list(by or [])


def join_groups(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Inner join on the group columns, where a null group equals a null group.

    Without group columns ``right`` is one row.  ``right`` has one row per group.
    """
    by = _by(by)
    if not by:
        return left.crossJoin(right)
    keys = [f"__g{i}" for i in range(len(by))]
    right = right.select(*[as_col(b).alias(k) for b, k in zip(by, keys)], *[as_col(c) for c in right.columns if c not in by])
    cond = [as_col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]
    return left.join(right, cond, "inner").drop(*keys)


# ---------------------------------------------------------------- binary counts

def binary_counts(df: DataFrame, y="y", yh="yh", by=()) -> DataFrame:
    by = _by(by)
    yc, hc = as_col(y), as_col(yh)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if((yc == 1) & (hc == 1)).alias("tp"),
        count_if((yc == 0) & (hc == 1)).alias("fp"),
        count_if((yc == 0) & (hc == 0)).alias("tn"),
        count_if((yc == 1) & (hc == 0)).alias("fn"))


def binary_metrics(df: DataFrame, y="y", yh="yh", p="p", by=()) -> DataFrame:
    """Accuracy, precision, recall, F1 (class 1, zero_division=0), specificity,
    Brier score and log loss per group (M1-M4, M7-M9)."""
    by = _by(by)
    yc, hc = as_col(y), as_col(yh)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        count_if((yc == 1) & (hc == 1)).alias("tp"),
        count_if((yc == 0) & (hc == 1)).alias("fp"),
        count_if((yc == 0) & (hc == 0)).alias("tn"),
        count_if((yc == 1) & (hc == 0)).alias("fn"),
    ]
    if p is not None:
        pc = as_col(p).cast("double")
        clipped = F.least(F.greatest(pc, F.lit(EPS)), F.lit(1.0 - EPS))
        p_true = F.when(yc == 1, clipped).otherwise(F.lit(1.0) - clipped)
        aggs += [F.avg(F.pow(pc - yc.cast("double"), 2)).alias("brier"),
                 F.avg(-F.log(p_true)).alias("log_loss")]
    g = df.groupBy(*by).agg(*aggs)
    prec = zero_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = zero_div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = g.select(
        *by, "n",
        safe_div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        zero_div(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        safe_div(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        *([F.col("brier"), F.col("log_loss")] if p is not None else []))
    return out


# ------------------------------------------------------------ multi-class counts

def confusion_matrix(df: DataFrame, y="y", yh="yh", by=()) -> DataFrame:
    """(by..., y, yh, n): the non-zero cells of the confusion matrix."""
    by = _by(by)
    return df.groupBy(*by, as_col(y).alias("y"), as_col(yh).alias("yh")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_counts(df: DataFrame, y="y", yh="yh", by=()) -> DataFrame:
    """tp, fp, fn, support per (group, class) for every class seen in y or yh."""
    by = _by(by)
    cm = confusion_matrix(df, y, yh, by)
    as_true = cm.select(*by, F.col("y").alias("cls"),
                        F.when(F.col("y") == F.col("yh"), F.col("n")).otherwise(0).alias("tp"),
                        F.lit(0).cast("bigint").alias("fp"),
                        F.when(F.col("y") != F.col("yh"), F.col("n")).otherwise(0).alias("fn"),
                        F.col("n").alias("support"))
    as_pred = cm.where(F.col("y") != F.col("yh")).select(
        *by, F.col("yh").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("fp"),
        F.lit(0).cast("bigint").alias("fn"), F.lit(0).cast("bigint").alias("support"))
    return as_true.unionByName(as_pred).groupBy(*by, "cls").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "support")])


def classification_report(df: DataFrame, y="y", yh="yh", by=()) -> DataFrame:
    """Per-class precision, recall, F1 and support."""
    by = _by(by)
    pc = per_class_counts(df, y, yh, by)
    return pc.select(
        *by, "cls",
        zero_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        zero_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        zero_div(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        "support")


def macro_metrics(df: DataFrame, y="y", yh="yh", by=()) -> DataFrame:
    """Accuracy and macro precision / recall / F1 (zero_division=0) per group."""
    by = _by(by)
    rep = classification_report(df, y, yh, by).groupBy(*by).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))
    acc = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                              F.avg((as_col(y) == as_col(yh)).cast("double")).alias("accuracy"))
    return join_groups(acc, rep, by)


# --------------------------------------------------------------- ordered metrics

def _pos_neg(df, y, p, by):
    return df.select(*[as_col(b).alias(b) for b in by], as_col(p).cast("double").alias("score"),
                     F.when(as_col(y) == 1, 1).otherwise(0).cast("bigint").alias("pos"),
                     F.when(as_col(y) == 1, 0).otherwise(1).cast("bigint").alias("neg"))


def auc(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """Binary ROC AUC with ties counted half (M5) and Gini = 2·AUC − 1.

    AUC = Σ pos·(negatives below + ties/2) / (P·N); null when a class is absent.
    """
    by = _by(by)
    return auc_of_counts(_pos_neg(df, y, p, by), by)


def auc_of_counts(counts: DataFrame, by=()) -> DataFrame:
    """``auc`` of (by..., score, pos, neg): rows or groups with their number of positives and negatives.

    Each bucket of scores is summed up where its window runs; only the table of buckets is
    ordered as a whole, so no row is joined with the totals of the buckets below it.
    """
    by = _by(by)
    pre, parts = distinct_values(counts, "score", ["pos", "neg"], by)
    upto = Window.partitionBy(*by, *parts).orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum("neg").over(upto) - F.col("neg") + F.col("neg") / F.lit(2.0)      # negatives of the same bucket
    buckets = pre.select(*by, *parts, "pos", "neg", (F.col("pos") * below).alias("_u")).groupBy(*by, *parts).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum("_u").alias("_u"))
    earlier = Window.partitionBy(*by).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)   # one row a bucket
    u = F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("double")
    g = buckets.select(*by, "_p", "_n", u.alias("_u")).groupBy(*by).agg(
        F.sum("_p").cast("bigint").alias("n_pos"), F.sum("_n").cast("bigint").alias("n_neg"), F.sum("_u").alias("_u"))
    a = safe_div(F.col("_u"), F.col("n_pos") * F.col("n_neg"))
    return g.select(*by, "n_pos", "n_neg", a.alias("auc"), (F.lit(2.0) * a - F.lit(1.0)).alias("gini"))


def curve_points(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """Per distinct score (descending): tps/fps at threshold >= score and totals."""
    by = _by(by)
    rs = running_sums(_pos_neg(df, y, p, by), "score", ["pos", "neg"], by, descending=True)
    tot = rs.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return join_groups(rs, tot, by).select(*by, F.col("score").alias("threshold"), "pos", "neg",
                      F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"), "P", "N",
                      F.col("next_score"))


def roc_curve(df: DataFrame, y="y", p="p", by=(), drop_intermediate: bool = True) -> DataFrame:
    """ROC points (threshold, fpr, tpr) as ``sklearn.metrics.roc_curve``.

    Starts at (inf, 0, 0).  With ``drop_intermediate`` a point whose next increment
    equals its own (collinear) is dropped; first and last are kept.  The next point
    is found by an equi-join on the next distinct score, not by a global window.
    """
    by = _by(by)
    pts = curve_points(df, y, p, by)
    if drop_intermediate:
        nxt = pts.select(*by, F.col("threshold").alias("_t2"), F.col("pos").alias("_pos2"),
                         F.col("neg").alias("_neg2"))
        cond = [pts[b].eqNullSafe(nxt[b]) for b in by] + [pts["next_score"] == nxt["_t2"]]
        j = pts.join(nxt, cond, "left").select(pts["*"], "_pos2", "_neg2")
        first = j["tps"] == j["pos"]
        first = first & (j["fps"] == j["neg"])
        keep = (first | j["next_score"].isNull() |
                (j["_pos2"] != j["pos"]) | (j["_neg2"] != j["neg"]))
        pts = j.where(keep).drop("_pos2", "_neg2")
    body = pts.select(*by, "threshold", safe_div(F.col("fps"), F.col("N")).alias("fpr"),
                      safe_div(F.col("tps"), F.col("P")).alias("tpr"))
    start = pts.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"),
                                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(body)


def pr_curve(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """Precision-recall points as ``precision_recall_curve`` (M14): one row per distinct
    threshold plus the end point (null threshold, precision 1, recall 0)."""
    by = _by(by)
    pts = curve_points(df, y, p, by)
    recall = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(safe_div(F.col("tps"), F.col("P")))
    body = pts.select(*by, "threshold",
                      zero_div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                      recall.alias("recall"))
    end = pts.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                            F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)


def average_precision(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """AP = Σ (R_k − R_{k−1})·P_k (M13) and the prevalence baseline."""
    by = _by(by)
    pts = curve_points(df, y, p, by)
    term = safe_div(F.col("pos"), F.col("P")) * zero_div(F.col("tps"), F.col("tps") + F.col("fps"))
    return pts.groupBy(*by).agg(
        F.sum(term).alias("average_precision"),
        safe_div(F.first("P"), F.first("P") + F.first("N")).alias("prevalence"))


def ks_statistic(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """KS = max(tpr − fpr) over the ROC points, including (0, 0)."""
    by = _by(by)
    pts = curve_points(df, y, p, by)
    d = safe_div(F.col("tps"), F.col("P")) - safe_div(F.col("fps"), F.col("N"))
    return pts.groupBy(*by).agg(F.greatest(F.max(d), F.lit(0.0)).alias("ks"))


def auc_ovr(df: DataFrame, y="y", probs="probs", by=()) -> DataFrame:
    """One-vs-rest AUC per class from an ``array<double>`` of probabilities (M6)."""
    by = _by(by)
    ex = df.select(*[as_col(b).alias(b) for b in by], as_col(y).alias("_y"),
                   F.posexplode(as_col(probs)).alias("cls", "_pc"))
    ex = ex.withColumn("_yc", F.when(F.col("_y") == F.col("cls"), 1).otherwise(0))
    return auc(ex, "_yc", "_pc", by + ["cls"]).select(*by, "cls", "n_pos", "n_neg", "auc")


def auc_ovr_macro(df: DataFrame, y="y", probs="probs", by=()) -> DataFrame:
    by = _by(by)
    return auc_ovr(df, y, probs, by).groupBy(*by).agg(F.avg("auc").alias("auc_macro"))


def multiclass_log_loss(df: DataFrame, y="y", probs="probs", by=()) -> DataFrame:
    """Log loss with probabilities clipped to [eps, 1−eps] (M8)."""
    by = _by(by)
    pt = F.element_at(as_col(probs), as_col(y).cast("int") + 1)
    clipped = F.least(F.greatest(pt, F.lit(EPS)), F.lit(1.0 - EPS))
    return df.groupBy(*by).agg(F.avg(-F.log(clipped)).alias("log_loss"))


# ----------------------------------------------------------------- regression

def regression_metrics(df: DataFrame, y="y", yh="yh", by=(), n_features: int = 0) -> DataFrame:
    """MSE, RMSE, MAE, R², adjusted R² and MAPE % (y = 0 rows left out)."""
    by = _by(by)
    yc, hc = as_col(y).cast("double"), as_col(yh).cast("double")
    res = yc - hc
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(res * res).alias("mse"),
        F.avg(F.abs(res)).alias("mae"),
        F.sum(res * res).alias("_ss_res"),
        (F.var_pop(yc) * F.count(F.lit(1))).alias("_ss_tot"),
        (F.avg(F.when(yc != 0, F.abs(res / yc))) * F.lit(100.0)).alias("mape"))
    r2 = (F.when(F.col("_ss_tot") == 0, F.when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - safe_div(F.col("_ss_res"), F.col("_ss_tot"))))
    den = F.greatest(F.col("n") - F.lit(n_features) - F.lit(1), F.lit(1))
    return g.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"),
                    (F.lit(1.0) - (F.lit(1.0) - r2) * (F.col("n") - F.lit(1)) / den).alias("adj_r2"),
                    "mape")


def residuals(df: DataFrame, id="id", y="y", yh="yh") -> DataFrame:
    """(id, actual, predicted, residual)."""
    return df.select(as_col(id).alias("id"), as_col(y).cast("double").alias("actual"),
                     as_col(yh).cast("double").alias("predicted"),
                     (as_col(y) - as_col(yh)).cast("double").alias("residual"))


# ------------------------------------------------------------------ dispatcher

CLASSIFICATION_METRICS = ("ACC", "AUC", "F1")
REGRESSION_METRICS = ("MSE", "MAE", "R2")
LOWER_IS_BETTER = {"MSE", "MAE"}


def evaluate(df: DataFrame, metric: str, by=(), y="y", p="p", probs=None, yh=None,
             threshold: float = 0.5, n_classes: int | None = None) -> DataFrame:
    """The reference's ``evaluate_score`` as a grouped aggregate.

    Classification: labels are ``p >= threshold`` (binary) or the arg max of
    ``probs``; AUC is binary or one-vs-rest macro, null when a group holds one class.
    Returns (by..., metric, value).
    """
    by = _by(by)
    metric = metric.upper()
    multi = probs is not None and (n_classes is None or n_classes > 2)
    if metric in REGRESSION_METRICS:
        pred = as_col(yh if yh is not None else p)
        m = regression_metrics(df.withColumn("_yh", pred), y, "_yh", by)
        col = {"MSE": "mse", "MAE": "mae", "R2": "r2"}[metric]
        return m.select(*by, F.lit(metric).alias("metric"), F.col(col).alias("value"))
    if metric not in CLASSIFICATION_METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    if multi:
        arr = as_col(probs)
        label = F.array_position(arr, F.array_max(arr)) - F.lit(1)
    else:
        label = F.when(as_col(p) >= F.lit(threshold), 1).otherwise(0)
    scored = df.withColumn("_yh", label if yh is None else as_col(yh))
    if metric == "ACC":
        m = scored.groupBy(*by).agg(F.avg((as_col(y) == F.col("_yh")).cast("double")).alias("value"))
    elif metric == "F1":
        if multi:
            m = macro_metrics(scored, y, "_yh", by).select(*by, F.col("f1_macro").alias("value"))
        else:
            m = binary_metrics(scored, y, "_yh", None, by).select(*by, F.col("f1").alias("value"))
    else:
        if multi:
            m = auc_ovr(scored, y, probs, by).groupBy(*by).agg(
                F.when(F.min(F.least("n_pos", "n_neg")) > 0, F.avg("auc")).alias("value"))
        else:
            m = auc(scored, y, p, by).select(*by, F.col("auc").alias("value"))
    return m.select(*by, F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))
