"""Checks for the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import metrics as m
from probity.registry import register, rounded
from probity.sources import fixtures as fx
from probity.sources.fixtures import with_views

# Shared DuckDB fragments: per distinct score, positives/negatives and running sums.
_CURVE = """
d AS (SELECT split, p AS threshold, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
      FROM clf GROUP BY split, p),
c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
             sum(pos) OVER (PARTITION BY split) AS P, sum(neg) OVER (PARTITION BY split) AS N,
             lead(pos) OVER (PARTITION BY split ORDER BY threshold DESC) AS pos2,
             lead(neg) OVER (PARTITION BY split ORDER BY threshold DESC) AS neg2,
             row_number() OVER (PARTITION BY split ORDER BY threshold DESC) AS k
      FROM d WINDOW w AS (PARTITION BY split ORDER BY threshold DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@register("auc_binary", with_views("""
SELECT split, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg, round(auc, 6) AS auc,
       round(2.0::DOUBLE * auc - 1.0::DOUBLE, 6) AS gini FROM a
""", "clf", ctes="""
d AS (SELECT split, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
      FROM clf GROUP BY split, p),
r AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM d),
a AS (SELECT split, sum(pos) AS P, sum(neg) AS N,
             sum(pos * (cum_neg - neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc
      FROM r GROUP BY split)
"""))
def auc_binary(spark, d):
    return rounded(m.auc(fx.clf(spark, d), by="split"))


@register("binary_metrics", with_views("""
SELECT split, n, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(CASE WHEN tn + fp = 0 THEN NULL ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS specificity,
       round(brier, 6) AS brier, round(log_loss, 6) AS log_loss
FROM (SELECT split, count(*) AS n,
             CAST(sum(CASE WHEN y = 1 AND yh = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN y = 0 AND yh = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN y = 0 AND yh = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN y = 1 AND yh = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             avg((p - y) * (p - y)) AS brier,
             avg(-ln(CASE WHEN y = 1 THEN least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                          ELSE 1.0 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END))
               AS log_loss
      FROM clf GROUP BY split) t
""", "clf"))
def binary_metrics(spark, d):
    return rounded(m.binary_metrics(fx.clf(spark, d), by="split"))


_PER_CLASS = """
cm AS (SELECT split, y, yh, count(*) AS n FROM multi GROUP BY split, y, yh),
pc AS (SELECT split, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
              CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support
       FROM (SELECT split, y AS cls, CASE WHEN y = yh THEN n ELSE 0 END AS tp, 0 AS fp,
                    CASE WHEN y <> yh THEN n ELSE 0 END AS fn, n AS support FROM cm
             UNION ALL
             SELECT split, yh AS cls, 0, n, 0, 0 FROM cm WHERE y <> yh) u
       GROUP BY split, cls),
rep AS (SELECT split, cls,
               CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
               support FROM pc)
"""


@register("macro_metrics", with_views("""
SELECT acc.split, n, round(accuracy, 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
       round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro
FROM acc JOIN rep ON acc.split = rep.split GROUP BY acc.split, n, accuracy
""", "multi", ctes=_PER_CLASS + """,
acc AS (SELECT split, count(*) AS n, avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM multi GROUP BY split)
"""))
def macro_metrics(spark, d):
    return rounded(m.macro_metrics(fx.multi(spark, d), by="split"))


@register("class_report", with_views("""
SELECT split, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM rep
""", "multi", ctes=_PER_CLASS))
def class_report(spark, d):
    return rounded(m.classification_report(fx.multi(spark, d), by="split"))


@register("confusion_matrix", with_views(
    "SELECT split, y, yh, count(*) AS n FROM multi GROUP BY split, y, yh", "multi"))
def confusion_matrix(spark, d):
    return rounded(m.confusion_matrix(fx.multi(spark, d), by="split"))


_OVR = """
ex AS (SELECT split, cls, CASE WHEN y = cls THEN 1 ELSE 0 END AS yc,
              CASE cls WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pc
       FROM multi CROSS JOIN (SELECT unnest([0, 1, 2]) AS cls) k),
d AS (SELECT split, cls, pc, CAST(sum(yc) AS DOUBLE) AS pos, CAST(sum(1 - yc) AS DOUBLE) AS neg
      FROM ex GROUP BY split, cls, pc),
r AS (SELECT *, sum(neg) OVER (PARTITION BY split, cls ORDER BY pc
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM d),
a AS (SELECT split, cls, sum(pos) AS P, sum(neg) AS N,
             sum(pos * (cum_neg - neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auc
      FROM r GROUP BY split, cls)
"""


@register("auc_ovr", with_views("""
SELECT split, cls, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg, round(auc, 6) AS auc FROM a
""", "multi", ctes=_OVR))
def auc_ovr(spark, d):
    return rounded(m.auc_ovr(fx.multi(spark, d), by="split"))


@register("log_loss_multi", with_views("""
SELECT split, round(avg(-ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END,
                                           2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6)
       AS log_loss FROM multi GROUP BY split
""", "multi"))
def log_loss_multi(spark, d):
    return rounded(m.multiclass_log_loss(fx.multi(spark, d), by="split"))


@register("roc_curve", with_views("""
SELECT split, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (
  SELECT split, threshold, CAST(fps AS DOUBLE) / N AS fpr, CAST(tps AS DOUBLE) / P AS tpr FROM c
  WHERE k = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
  UNION ALL
  SELECT DISTINCT split, 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM clf) u
""", "clf", ctes=_CURVE))
def roc_curve(spark, d):
    return rounded(m.roc_curve(fx.clf(spark, d), by="split"))


@register("pr_curve", with_views("""
SELECT split, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (
  SELECT split, threshold, CAST(tps AS DOUBLE) / (tps + fps) AS precision,
         CASE WHEN P = 0 THEN 1.0 ELSE CAST(tps AS DOUBLE) / P END AS recall FROM c
  UNION ALL
  SELECT DISTINCT split, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM clf) u
""", "clf", ctes=_CURVE))
def pr_curve(spark, d):
    return rounded(m.pr_curve(fx.clf(spark, d), by="split"))


@register("average_precision", with_views("""
SELECT split, round(sum(CAST(pos AS DOUBLE) / P * (CAST(tps AS DOUBLE) / (tps + fps))), 6) AS average_precision,
       round(CAST(max(P) AS DOUBLE) / (max(P) + max(N)), 6) AS prevalence FROM c GROUP BY split
""", "clf", ctes=_CURVE))
def average_precision(spark, d):
    return rounded(m.average_precision(fx.clf(spark, d), by="split"))


@register("ks_statistic", with_views("""
SELECT split, round(greatest(max(CAST(tps AS DOUBLE) / P - CAST(fps AS DOUBLE) / N), 0.0), 6) AS ks
FROM c GROUP BY split
""", "clf", ctes=_CURVE))
def ks_statistic(spark, d):
    return rounded(m.ks_statistic(fx.clf(spark, d), by="split"))


@register("regression_metrics", with_views("""
SELECT split, n, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
       round(r2, 6) AS r2,
       round(1.0 - (1.0 - r2) * (n - 1) / greatest(n - 4 - 1, 1), 6) AS adj_r2, round(mape, 6) AS mape
FROM (SELECT split, n, mse, mae, mape,
             CASE WHEN ss_tot = 0 THEN CASE WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1.0 - ss_res / ss_tot END AS r2
      FROM (SELECT split, count(*) AS n, avg((y - yh) * (y - yh)) AS mse, avg(abs(y - yh)) AS mae,
                   sum((y - yh) * (y - yh)) AS ss_res, var_pop(y) * count(*) AS ss_tot,
                   avg(CASE WHEN y <> 0 THEN abs((y - yh) / y) END) * 100.0 AS mape
            FROM reg GROUP BY split) a) b
""", "reg"))
def regression_metrics(spark, d):
    return rounded(m.regression_metrics(fx.reg(spark, d), by="split", n_features=4))


@register("residuals", with_views("""
SELECT id, round(y, 6) AS actual, round(yh, 6) AS predicted, round(y - yh, 6) AS residual FROM reg
""", "reg"))
def residuals(spark, d):
    return rounded(m.residuals(fx.reg(spark, d)))


_EVAL = """
bin AS (SELECT split, count(*) AS n,
                 sum(CASE WHEN y = 1 AND yh = 1 THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN y = 0 AND yh = 1 THEN 1 ELSE 0 END) AS fp,
                 sum(CASE WHEN y = 1 AND yh = 0 THEN 1 ELSE 0 END) AS fn,
                 avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS acc FROM clf GROUP BY split),
ad AS (SELECT split, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM clf GROUP BY split, p),
ar AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM ad),
aa AS (SELECT split, sum(pos * (cn - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM ar GROUP BY split),
rg AS (SELECT split, avg((y - yh) * (y - yh)) AS mse, avg(abs(y - yh)) AS mae,
              1.0 - sum((y - yh) * (y - yh)) / (var_pop(y) * count(*)) AS r2 FROM reg GROUP BY split)
"""


@register("evaluate_dispatch", with_views("""
SELECT 'clf' AS fixture, split, 'ACC' AS metric, round(acc, 6) AS value FROM bin
UNION ALL SELECT 'clf', split, 'F1', round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) FROM bin
UNION ALL SELECT 'clf', split, 'AUC', round(auc, 6) FROM aa
UNION ALL SELECT 'reg', split, 'MSE', round(mse, 6) FROM rg
UNION ALL SELECT 'reg', split, 'MAE', round(mae, 6) FROM rg
UNION ALL SELECT 'reg', split, 'R2', round(r2, 6) FROM rg
""", "clf", "reg", ctes=_EVAL))
def evaluate_dispatch(spark, d):
    c = fx.clf(spark, d)
    r = fx.reg(spark, d)
    parts = [m.evaluate(c, k, by="split").withColumn("fixture", F.lit("clf")) for k in ("ACC", "F1", "AUC")]
    parts += [m.evaluate(r, k, by="split", yh="yh").withColumn("fixture", F.lit("reg"))
              for k in ("MSE", "MAE", "R2")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out.select("fixture", "split", "metric", "value"))


@register("segment_metrics", with_views("""
SELECT grp, split, n, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(CASE WHEN tn + fp = 0 THEN NULL ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS specificity
FROM (SELECT grp, split, count(*) AS n,
             sum(CASE WHEN y = 1 AND yh = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN y = 0 AND yh = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN y = 0 AND yh = 0 THEN 1 ELSE 0 END) AS tn,
             sum(CASE WHEN y = 1 AND yh = 0 THEN 1 ELSE 0 END) AS fn
      FROM clf GROUP BY grp, split) t""", "clf"))
def segment_metrics(spark, d):
    """Segment- and group-level performance (V8): any grouping columns."""
    return rounded(m.binary_metrics(fx.clf(spark, d), p=None, by=["grp", "split"]))
