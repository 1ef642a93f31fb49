"""Checks for reliability, resilience and fairness (R, K, N, V10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import fairness, reliability as rel, resilience as res
from probity.registry import register, rounded
from probity.sources import fixtures as fx
from probity.sources.fixtures import HL, with_views

# ----------------------------------------------------------------- reliability

_STR = """
cal AS (SELECT id, 1.0 - CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS s FROM multi WHERE split = 'cal'),
tst AS (SELECT id, 1.0 - greatest(p0, p1, p2) AS s FROM multi WHERE split = 'test')
"""


def _cal_test(spark, d):
    m = fx.multi(spark, d)
    cal = rel.calibration_strangeness(m.where(F.col("split") == "cal"), "y", probs="probs")
    tst = rel.test_strangeness(m.where(F.col("split") == "test"), probs="probs")
    return cal, tst


@register("strangeness", with_views("""
SELECT id, 'cal' AS split, round(s, 6) AS strangeness FROM cal
UNION ALL SELECT id, 'test', round(s, 6) FROM tst""", "multi", ctes=_STR))
def strangeness(spark, d):
    cal, tst = _cal_test(spark, d)
    return rounded(cal.select("id", "split", "strangeness").unionByName(tst.select("id", "split", "strangeness")))


@register("conformal_summary", with_views("""
SELECT 0.95::DOUBLE AS alpha, round(c, 6) AS cutoff, count(*) AS n_test,
       round(avg(CASE WHEN s <= c THEN 1.0 ELSE 0.0 END), 6) AS share_conformal,
       round(1.0 - avg(CASE WHEN s <= c THEN 1.0 ELSE 0.0 END), 6) AS share_non_conformal
FROM tst CROSS JOIN (SELECT quantile_cont(s, 0.95) AS c FROM cal) q GROUP BY c""", "multi", ctes=_STR))
def conformal_summary(spark, d):
    cal, tst = _cal_test(spark, d)
    return rounded(rel.conformal_summary(cal, tst, "strangeness", 0.95))


@register("conformal_pvalues", with_views("""
SELECT t.id, round(t.s, 6) AS strangeness,
       round((SELECT count(*) FROM cal c WHERE c.s >= t.s) / (SELECT count(*) FROM cal), 6) AS p_value
FROM tst t""", "multi", ctes=_STR))
def conformal_pvalues(spark, d):
    cal, tst = _cal_test(spark, d)
    return rounded(rel.conformal_pvalues(cal, tst, "strangeness", "id"))


def _hist_sql(src: str, col: str, bins: int, density: bool) -> str:
    dens = (", round(coalesce(c.n, 0) / (st.n * (e[g.bin + 2] - e[g.bin + 1])), 6) AS density"
            if density else "")
    return f"""
st AS (SELECT min({col}) AS lo, max({col}) AS hi, count({col}) AS n FROM {src}),
ed AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS l2, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS h2
       FROM st),
ee AS (SELECT [i * ((h2 - l2) / {bins}.0) + l2 FOR i IN range({bins})] || [h2] AS e FROM ed),
bb AS (SELECT len(list_filter(e[2:{bins}], lambda x: x <= {col})) AS bin FROM {src} CROSS JOIN ee
       WHERE {col} IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM bb GROUP BY bin),
hist AS (SELECT g.bin, round(e[g.bin + 1], 6) AS lower, round(e[g.bin + 2], 6) AS upper,
                CAST(coalesce(c.n, 0) AS BIGINT) AS count{dens}
         FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN ee CROSS JOIN st LEFT JOIN c ON g.bin = c.bin)
"""


@register("pvalue_histogram", with_views("SELECT * FROM hist", "multi", ctes=_STR + """,
pv AS (SELECT (SELECT count(*) FROM cal c WHERE c.s >= t.s) / (SELECT count(*) FROM cal) AS p_value FROM tst t),
""" + _hist_sql("pv", "p_value", 10, True)))
def pvalue_histogram(spark, d):
    cal, tst = _cal_test(spark, d)
    pv = rel.conformal_pvalues(cal, tst, "strangeness", "id")
    return rounded(rel.histogram_table(pv, "p_value", 10, density=True))


@register("strangeness_histogram", with_views("SELECT * FROM hist", "multi",
                                              ctes=_STR + "," + _hist_sql("tst", "s", 30, False)))
def strangeness_histogram(spark, d):
    _, tst = _cal_test(spark, d)
    return rounded(rel.histogram_table(tst, "strangeness", 30))


@register("sorted_strangeness", with_views("""
SELECT st AS set, round(s, 6) AS strangeness,
       round(CAST(sum(cnt) OVER (PARTITION BY st ORDER BY s) - cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY st), 6)
         AS position, cnt AS n_at
FROM (SELECT 'cal' AS st, s, count(*) AS cnt FROM cal GROUP BY s
      UNION ALL SELECT 'test', s, count(*) FROM tst GROUP BY s) u""", "multi", ctes=_STR))
def sorted_strangeness(spark, d):
    cal, tst = _cal_test(spark, d)
    both = cal.select(F.lit("cal").alias("set"), "strangeness").unionByName(
        tst.select(F.lit("test").alias("set"), "strangeness"))
    return rounded(rel.sorted_positions(both, "strangeness", "set"))


@register("calibration_curve", with_views("""
SELECT bin, count(*) AS count, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive
FROM (SELECT p, y, len(list_filter([i * (1.0 / 10) FOR i IN range(1, 10)], lambda e: e < p)) AS bin
      FROM clf WHERE split = 'test' AND p >= 0.0 AND p <= 1.0) t GROUP BY bin""", "clf"))
def calibration_curve(spark, d):
    c = fx.clf(spark, d).where(F.col("split") == "test")
    return rounded(rel.calibration_curve(c, "y", "p", 10))


_CREG = """
rc AS (SELECT abs(y - yh) AS r FROM reg WHERE split = 'cal'),
rt AS (SELECT id, y, yh, abs(y - yh) AS r FROM reg WHERE split = 'test'),
cut AS (SELECT quantile_cont(r, 0.9) AS c FROM rc)
"""


@register("conformal_regression", with_views("""
SELECT 0.9::DOUBLE AS alpha, round(c, 6) AS cutoff, count(*) AS n_test,
       round(avg(CASE WHEN r <= c THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_within,
       round(100.0 - avg(CASE WHEN r <= c THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_outside
FROM rt CROSS JOIN cut GROUP BY c""", "reg", ctes=_CREG))
def conformal_regression(spark, d):
    r = fx.reg(spark, d)
    _, summary = rel.conformal_regression(r.where(F.col("split") == "cal"), r.where(F.col("split") == "test"),
                                          alpha=0.9)
    return rounded(summary)


@register("conformal_intervals", with_views("""
SELECT id, round(yh, 6) AS predicted, round(yh - c, 6) AS lower, round(yh + c, 6) AS upper,
       round(y, 6) AS actual, CAST(r <= c AS BIGINT) AS within FROM rt CROSS JOIN cut""", "reg", ctes=_CREG))
def conformal_intervals(spark, d):
    r = fx.reg(spark, d)
    rows, _ = rel.conformal_regression(r.where(F.col("split") == "cal"), r.where(F.col("split") == "test"),
                                       alpha=0.9)
    return rounded(rows)


@register("residual_histogram", with_views("SELECT * FROM hist", "reg", ctes="""
rr AS (SELECT y - yh AS residual FROM reg WHERE split = 'test'),""" + _hist_sql("rr", "residual", 30, False)))
def residual_histogram(spark, d):
    r = fx.reg(spark, d).where(F.col("split") == "test")
    return rounded(rel.residual_histogram(r, bins=30))


# ----------------------------------------------------------------- resilience

def _psi_sql(kind: str) -> str:
    if kind == "bins":
        edges = """ed AS (SELECT feature, CASE WHEN hi = lo THEN [lo FOR i IN range(11)]
                       ELSE [(i / 10 * 100) / (100 / (hi - lo)) + lo FOR i IN range(11)] END AS e
                   FROM (SELECT feature, min(value) AS lo, max(value) AS hi FROM lg WHERE side = 'expected'
                         GROUP BY feature) s)"""
    else:
        qs = ", ".join(repr((i / 10 * 100) / 100) for i in range(11))
        edges = f"""ed AS (SELECT feature, quantile_cont(value, [{qs}]) AS e FROM lg WHERE side = 'expected'
                   GROUP BY feature)"""
    return f"""
lg AS (SELECT CASE WHEN split = 'train' THEN 'expected' ELSE 'actual' END AS side, u.*
       FROM (SELECT split, 'f1' AS feature, f1 AS value FROM clf UNION ALL SELECT split, 'f2', f2 FROM clf
             UNION ALL SELECT split, 'f3', f3 FROM clf UNION ALL SELECT split, 'f4', f4 FROM clf) u
       WHERE split IN ('train', 'test')),
{edges},
bn AS (SELECT lg.feature, side, CASE WHEN value >= e[1] AND value <= e[11]
                                     THEN len(list_filter(e[2:10], lambda x: x <= value)) END AS bin
       FROM lg JOIN ed ON lg.feature = ed.feature),
nn AS (SELECT feature, sum(CASE WHEN side = 'expected' THEN 1 ELSE 0 END) AS ne,
              sum(CASE WHEN side = 'actual' THEN 1 ELSE 0 END) AS na FROM bn GROUP BY feature),
cc AS (SELECT feature, bin, sum(CASE WHEN side = 'expected' THEN 1 ELSE 0 END) AS ce,
              sum(CASE WHEN side = 'actual' THEN 1 ELSE 0 END) AS ca FROM bn WHERE bin IS NOT NULL
       GROUP BY feature, bin),
gg AS (SELECT feature, unnest(range(10)) AS bin FROM ed),
sh AS (SELECT gg.feature, CASE WHEN coalesce(ce, 0) = 0 THEN 0.0001 ELSE ce / ne END AS e,
              CASE WHEN coalesce(ca, 0) = 0 THEN 0.0001 ELSE ca / na END AS a
       FROM gg LEFT JOIN cc ON gg.feature = cc.feature AND gg.bin = cc.bin JOIN nn ON gg.feature = nn.feature)
"""


def _train_test(spark, d):
    c = fx.clf(spark, d).where(F.col("split").isin("train", "test"))
    return c.withColumn("side", F.when(F.col("split") == "train", "expected").otherwise("actual"))


@register("psi_by_feature", with_views("SELECT feature, round(sum((e - a) * ln(e / a)), 6) AS psi FROM sh "
                                       "GROUP BY feature", "clf", ctes=_psi_sql("bins")))
def psi_by_feature(spark, d):
    return rounded(res.psi(_train_test(spark, d), fx.FEATURES))


@register("psi_quantile", with_views("SELECT feature, round(sum((e - a) * ln(e / a)), 6) AS psi FROM sh "
                                     "GROUP BY feature", "clf", ctes=_psi_sql("quantiles")))
def psi_quantile(spark, d):
    return rounded(res.psi(_train_test(spark, d), fx.FEATURES, kind="quantiles"))


@register("distribution_distances", with_views("""
SELECT feature, round(sum(diff * coalesce(nxt - value, 0.0)), 6) AS wasserstein, round(max(diff), 6) AS ks
FROM (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt,
             abs(sum(ca) OVER w / sum(ca) OVER (PARTITION BY feature)
                 - sum(cb) OVER w / sum(cb) OVER (PARTITION BY feature)) AS diff
      FROM (SELECT feature, value, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS ca,
                   sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS cb
            FROM (SELECT split, 'f1' AS feature, f1 AS value FROM clf UNION ALL SELECT split, 'f2', f2 FROM clf
                  UNION ALL SELECT split, 'f3', f3 FROM clf UNION ALL SELECT split, 'f4', f4 FROM clf) u
            WHERE split IN ('train', 'test') GROUP BY feature, value) g
      WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
GROUP BY feature""", "clf"))
def distribution_distances(spark, d):
    return rounded(res.distribution_distances(_train_test(spark, d), fx.FEATURES))


def _reg_test(spark, d):
    r = fx.reg(spark, d).where(F.col("split") == "test")
    return res.residual_column(r, "regression")


_RANKED = f"""
rt AS (SELECT id, f1, y, yh, abs(y - yh) AS residual FROM reg WHERE split = 'test'),
rk AS (SELECT *, row_number() OVER (ORDER BY residual DESC, {HL('id')}, id) AS rnk, count(*) OVER () AS sz FROM rt)
"""


@register("worst_samples", with_views("SELECT id, round(residual, 6) AS residual FROM rk "
                                      "WHERE rnk <= floor(0.1 * sz)", "reg", ctes=_RANKED))
def worst_samples(spark, d):
    w = res.worst_samples(_reg_test(spark, d), 0.1, "residual", "id")
    return rounded(w.select("id", "residual"))


_DECILE = f"""
rt AS (SELECT id, f1, y, yh, abs(y - yh) AS residual FROM reg WHERE split = 'test'),
ed AS (SELECT list_sort(list_distinct(quantile_cont(f1, [{", ".join(repr(1.0 if i == 10 else i * 0.1)
                                                                    for i in range(11))}]))) AS e FROM rt),
bn AS (SELECT rt.*, len(list_filter(e[2:len(e) - 1], lambda x: x < f1)) + 1 AS bin FROM rt CROSS JOIN ed
       WHERE f1 >= e[1] AND f1 <= e[len(e)]),
rk AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY residual DESC, {HL('id')}, id) AS rnk,
              count(*) OVER (PARTITION BY bin) AS sz FROM bn)
"""


@register("worst_by_decile", with_views("SELECT id, round(residual, 6) AS residual FROM rk "
                                        "WHERE rnk <= floor(0.2 * sz)", "reg", ctes=_DECILE))
def worst_by_decile(spark, d):
    w = res.worst_samples(_reg_test(spark, d), 0.2, "residual", "id", feature="f1")
    return rounded(w.select("id", "residual"))


@register("resilience_sweep_reg", with_views("""
SELECT level, round(level / 10.0, 6) AS alpha, 'MAE' AS metric, round(avg(residual), 6) AS value,
       round((SELECT avg(abs(y - yh)) FROM rt), 6) AS overall
FROM rk CROSS JOIN (SELECT unnest(range(1, 11)) AS level) l WHERE rnk <= floor(sz * level / 10)
GROUP BY level""", "reg", ctes=_RANKED))
def resilience_sweep_reg(spark, d):
    return rounded(res.resilience_sweep(_reg_test(spark, d), "MAE", yh="yh"))


@register("resilience_sweep_clf", with_views("""
SELECT level, round(level / 10.0, 6) AS alpha, 'AUC' AS metric,
       round(sum(pos * (cn - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS value,
       round((SELECT sum(pos * (cn - neg + neg / 2.0)) / (sum(pos) * sum(neg)) FROM
              (SELECT pos, neg, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
               FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
                     FROM ct GROUP BY p) a) b), 6) AS overall
FROM (SELECT level, pos, neg,
             sum(neg) OVER (PARTITION BY level ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
      FROM (SELECT level, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM ck CROSS JOIN (SELECT unnest(range(1, 11)) AS level) l WHERE rnk <= floor(sz * level / 10)
            GROUP BY level, p) a) b
GROUP BY level""", "clf", ctes=f"""
ct AS (SELECT id, y, p, abs(p - y) AS residual FROM clf WHERE split = 'test'),
ck AS (SELECT *, row_number() OVER (ORDER BY residual DESC, {HL('id')}, id) AS rnk, count(*) OVER () AS sz FROM ct)
"""))
def resilience_sweep_clf(spark, d):
    c = res.residual_column(fx.clf(spark, d).where(F.col("split") == "test"), "classification")
    return rounded(res.resilience_sweep(c, "AUC"))


@register("worst_vs_all_psi", with_views("""
SELECT feature, round(sum((e - a) * ln(e / a)), 6) AS distance FROM sh GROUP BY feature""", "reg", ctes=_RANKED + """,
lg AS (SELECT 'expected' AS side, 'f1' AS feature, f1 AS value FROM rt
       UNION ALL SELECT 'actual', 'f1', f1 FROM rk WHERE rnk <= floor(0.1 * sz)),
ed AS (SELECT feature, CASE WHEN hi = lo THEN [lo FOR i IN range(11)]
                       ELSE [(i / 10 * 100) / (100 / (hi - lo)) + lo FOR i IN range(11)] END AS e
       FROM (SELECT feature, min(value) AS lo, max(value) AS hi FROM lg WHERE side = 'expected' GROUP BY feature) s),
bn AS (SELECT lg.feature, side, CASE WHEN value >= e[1] AND value <= e[11]
                                     THEN len(list_filter(e[2:10], lambda x: x <= value)) END AS bin
       FROM lg JOIN ed ON lg.feature = ed.feature),
nn AS (SELECT feature, sum(CASE WHEN side = 'expected' THEN 1 ELSE 0 END) AS ne,
              sum(CASE WHEN side = 'actual' THEN 1 ELSE 0 END) AS na FROM bn GROUP BY feature),
cc AS (SELECT feature, bin, sum(CASE WHEN side = 'expected' THEN 1 ELSE 0 END) AS ce,
              sum(CASE WHEN side = 'actual' THEN 1 ELSE 0 END) AS ca FROM bn WHERE bin IS NOT NULL
       GROUP BY feature, bin),
gg AS (SELECT feature, unnest(range(10)) AS bin FROM ed),
sh AS (SELECT gg.feature, CASE WHEN coalesce(ce, 0) = 0 THEN 0.0001 ELSE ce / ne END AS e,
              CASE WHEN coalesce(ca, 0) = 0 THEN 0.0001 ELSE ca / na END AS a
       FROM gg LEFT JOIN cc ON gg.feature = cc.feature AND gg.bin = cc.bin JOIN nn ON gg.feature = nn.feature)
"""))
def worst_vs_all_psi(spark, d):
    t = _reg_test(spark, d)
    w = res.worst_samples(t, 0.1, "residual", "id")
    return rounded(res.worst_vs_all_distance(t, w, ["f1"], "PSI"))


@register("worst_cluster_sweep")
def worst_cluster_sweep(spark, d):
    c = fx.clf(spark, d).where(F.col("split") == "test")
    return rounded(res.worst_cluster_sweep(c, fx.FEATURES, "AUC", max_k=10, n_init=10))


@register("worst_cluster_distances")
def worst_cluster_distances(spark, d):
    c = fx.clf(spark, d).where(F.col("split") == "test")
    worst = res.worst_cluster_rows(c, fx.FEATURES, 5, "ACC")
    found = [res.worst_vs_all_distance(c, worst, fx.FEATURES, m).withColumn("method", F.lit(m)) for m in ("PSI", "WD1", "KS")]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]))


@register("time_slice_drift", with_views("""
SELECT s.slice, s.feature, round(s.psi, 6) AS psi, s.n, round(a.score, 6) AS score
FROM (SELECT slice, feature, sum((e - a) * ln(e / a)) AS psi, max(na) AS n FROM sh GROUP BY slice, feature) s
LEFT JOIN acc a ON s.slice = a.slice""", "ev", ctes="""
sl AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS slice, f1, y, yh FROM ev),
ed AS (SELECT CASE WHEN hi = lo THEN [lo FOR i IN range(11)]
                   ELSE [(i / 10 * 100) / (100 / (hi - lo)) + lo FOR i IN range(11)] END AS e
       FROM (SELECT min(f1) AS lo, max(f1) AS hi FROM sl) s),
bn AS (SELECT slice, 'f1' AS feature, CASE WHEN f1 >= e[1] AND f1 <= e[11]
                                          THEN len(list_filter(e[2:10], lambda x: x <= f1)) END AS bin
       FROM sl CROSS JOIN ed),
ca AS (SELECT feature, bin, count(*) AS ce FROM bn WHERE bin IS NOT NULL GROUP BY feature, bin),
cs AS (SELECT slice, feature, bin, count(*) AS ca FROM bn WHERE bin IS NOT NULL GROUP BY slice, feature, bin),
na AS (SELECT feature, count(*) AS ne FROM bn GROUP BY feature),
ns AS (SELECT slice, feature, count(*) AS na FROM bn GROUP BY slice, feature),
gg AS (SELECT slice, feature, na, unnest(range(10)) AS bin FROM ns),
sh AS (SELECT gg.slice, gg.feature, gg.na,
              CASE WHEN coalesce(ce, 0) = 0 THEN 0.0001 ELSE ce / ne END AS e,
              CASE WHEN coalesce(cs.ca, 0) = 0 THEN 0.0001 ELSE cs.ca / gg.na END AS a
       FROM gg LEFT JOIN ca ON gg.feature = ca.feature AND gg.bin = ca.bin
       LEFT JOIN cs ON gg.slice = cs.slice AND gg.feature = cs.feature AND gg.bin = cs.bin
       JOIN na ON gg.feature = na.feature),
acc AS (SELECT slice, avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS score FROM sl GROUP BY slice)
"""))
def time_slice_drift(spark, d):
    e = fx.ev(spark, d)
    out = res.time_slice_drift(e, "ts", ["f1"], "1 day", metric="ACC")
    return rounded(out.select("slice", "feature", "psi", "n", "score"))


# ------------------------------------------------------------------- fairness

_FAIR_LABELS = f"""
ed AS (SELECT list_sort(list_distinct(quantile_cont(f1, [{", ".join(repr(1.0 if i == 10 else i * 0.1)
                                                                   for i in range(11))}]))) AS e FROM {{src}}),
lab AS (SELECT t.*, CASE WHEN f1 >= e[1] AND f1 <= e[len(e)]
                         THEN CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < f1)) + 1 AS VARCHAR) END AS f1_lab
        FROM {{tbl}} t CROSS JOIN ed WHERE split = 'test'),
lg AS (SELECT 'grp' AS feature, grp AS cls, {{cols}} FROM lab UNION ALL SELECT 'f1', f1_lab, {{cols}} FROM lab),
per AS (SELECT feature, cls, count(*) AS n, sum(pred) AS sel,
               sum(CASE WHEN pred = 1 AND y = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN pred = 1 AND y = 0 THEN 1 ELSE 0 END) AS fp,
               sum(pred * pred) AS ss FROM lg GROUP BY feature, cls),
tot AS (SELECT feature, sum(n) AS t_n, sum(sel) AS t_sel, sum(tp) AS t_tp, sum(fp) AS t_fp, sum(ss) AS t_ss
        FROM per GROUP BY feature),
g AS (SELECT per.*, t_n, t_sel, t_tp, t_fp, t_ss, n AS np, t_n - n AS nr FROM per JOIN tot USING (feature)
      WHERE cls IS NOT NULL)
"""


@register("fairness_ratios", with_views("""
SELECT feature, cls, np AS n_protected, nr AS n_reference, round(rp, 6) AS selection_protected,
       round(rr, 6) AS selection_reference, round(air, 6) AS air, round(pp, 6) AS ppv_protected,
       round(pr_, 6) AS ppv_reference, round(CASE WHEN pr_ <> 0 THEN pp / pr_ END, 6) AS pr
FROM (SELECT feature, cls, np, nr, rp, rr,
             CASE WHEN np > 0 AND nr > 0 AND rr <> 0 THEN rp / rr END AS air, pp, pr_
      FROM (SELECT feature, cls, np, nr, CASE WHEN np > 0 THEN sel / np END AS rp,
                   CASE WHEN nr > 0 THEN (t_sel - sel) / nr END AS rr,
                   CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pp,
                   CASE WHEN (t_tp - tp) + (t_fp - fp) > 0 THEN (t_tp - tp) / ((t_tp - tp) + (t_fp - fp)) END AS pr_
            FROM g) a) b
WHERE air IS NOT NULL""", "clf", ctes=_FAIR_LABELS.format(src="clf", tbl="clf", cols="CAST(yh AS DOUBLE) AS pred, y")))
def fairness_ratios(spark, d):
    c = fx.clf(spark, d)
    return rounded(fairness.fairness_ratios(c.where(F.col("split") == "test"), ["grp", "f1"], edges_from=c))


@register("smd_regression", with_views("""
SELECT feature, cls, np AS n_protected, nr AS n_reference, round(mp, 6) AS mean_protected,
       round(mr, 6) AS mean_reference,
       round((mp - mr) / sqrt(((np - 1) * vp + (nr - 1) * vr) / (np + nr - 2)), 6) AS smd
FROM (SELECT c.feature, c.cls, count(*) FILTER (WHERE lg.cls = c.cls) AS np,
             count(*) FILTER (WHERE lg.cls IS DISTINCT FROM c.cls) AS nr,
             avg(pred) FILTER (WHERE lg.cls = c.cls) AS mp, avg(pred) FILTER (WHERE lg.cls IS DISTINCT FROM c.cls) AS mr,
             var_samp(pred) FILTER (WHERE lg.cls = c.cls) AS vp,
             var_samp(pred) FILTER (WHERE lg.cls IS DISTINCT FROM c.cls) AS vr
      FROM (SELECT feature, cls FROM per WHERE cls IS NOT NULL) c JOIN lg ON lg.feature = c.feature
      GROUP BY c.feature, c.cls) a""", "reg",
    ctes=_FAIR_LABELS.format(src="reg", tbl="reg", cols="yh AS pred, 0 AS y")))
def smd_regression(spark, d):
    r = fx.reg(spark, d)
    return rounded(fairness.standardized_mean_difference(r.where(F.col("split") == "test"), ["grp", "f1"], "yh",
                                                         edges_from=r))
