"""Checks for explainability, overfitting, robustness, weak spots, training and
presets (X, O, B, L, F, S2).  Re-scoring uses the fixed arithmetic scorers, so the
DuckDB twin can re-score too; MLlib fits are rows-only checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from probity.operators import explain, overfit, robust, train, weakspot
from probity.operators.resilience import worst_cluster
from probity.operators.scoring import Scorer
from probity.registry import register, rounded
from probity.sources import files, fixtures as fx
from probity.sources.fixtures import CLF_P, G, H, U, with_views

_FEATS = fx.FEATURES
_TEST = "t AS (SELECT * FROM clf WHERE split = 'test')"


def _clf_test(spark, d):
    return fx.clf(spark, d).where(F.col("split") == "test")


def _case_feature(col: str, key: str, val: str) -> str:
    return f"CASE WHEN {key} = '{col}' THEN {val} ELSE {col} END AS {col}"


# ------------------------------------------------------- permutation importance

def _perm_grid():
    combos = [(f, r) for f in _FEATS for r in range(1, 11)]
    primes = explain._primes_above(explain._PERM_PRIME_BASE, len(combos))
    offs = [int(hashlib.md5(f"perm:0:{k}".encode()).hexdigest()[:7], 16) for k in range(len(combos))]
    return ", ".join(f"('{f}', {r}, {p}, {c})" for (f, r), p, c in zip(combos, primes, offs))


_PI = f"""
{_TEST},
k AS (SELECT t.*, 0 AS b FROM t),
sz AS (SELECT b, count(*) AS m FROM k GROUP BY b),
rv AS (SELECT k.*, row_number() OVER (PARTITION BY b ORDER BY {H('id', 'self:0')}, id) - 1 AS rn FROM k),
fr AS (SELECT * FROM (VALUES {_perm_grid()}) g(f, r, p, c)),
dn AS (SELECT fr.f, fr.r, rv.b, (fr.p * rv.rn + fr.c) % sz.m AS target,
              CASE fr.f WHEN 'f1' THEN rv.f1 WHEN 'f2' THEN rv.f2 WHEN 'f3' THEN rv.f3 ELSE rv.f4 END AS val
       FROM rv JOIN sz ON rv.b = sz.b CROSS JOIN fr),
pr AS (SELECT dn.f AS feat, dn.r AS rep, rv.y, {", ".join(_case_feature(c, "dn.f", "dn.val").replace(
    f"ELSE {c} END", f"ELSE rv.{c} END") for c in _FEATS)}
       FROM rv JOIN dn ON dn.b = rv.b AND dn.target = rv.rn),
sc AS (SELECT feat, rep, avg(CASE WHEN y = CASE WHEN p >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS score
       FROM (SELECT *, {CLF_P} AS p FROM pr) x GROUP BY feat, rep),
base AS (SELECT avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS base FROM t)
"""


@register("permutation_importance", with_views("""
SELECT feat AS feature, rep AS repeat, round(score, 6) AS score, round(base - score, 6) AS importance
FROM sc CROSS JOIN base""", "clf", ctes=_PI))
def permutation_importance(spark, d):
    return rounded(explain.permutation_importance(_clf_test(spark, d), fx.clf_scorer(), _FEATS, "ACC",
                                                  repeats=10, seed=0))


# ------------------------------------------------------------------ SHAP

_LSHAP = """
bg AS (SELECT avg(f1) AS m1, avg(f3) AS m3, avg(f4) AS m4 FROM reg WHERE split = 'train'),
t AS (SELECT * FROM reg WHERE split = 'test'),
ph AS (SELECT id, 'f1' AS feature, 2000.0 * (f1 - m1) AS phi,
              0.0 + 2000.0 * m1 + -5000.0 * m3 + 10000.0 * m4 AS base FROM t CROSS JOIN bg
       UNION ALL SELECT id, 'f3', -5000.0 * (f3 - m3), 0.0 + 2000.0 * m1 + -5000.0 * m3 + 10000.0 * m4
       FROM t CROSS JOIN bg
       UNION ALL SELECT id, 'f4', 10000.0 * (f4 - m4), 0.0 + 2000.0 * m1 + -5000.0 * m3 + 10000.0 * m4
       FROM t CROSS JOIN bg)
"""


def _linear_phi(spark, d):
    r = fx.reg(spark, d)
    return explain.linear_shap(r.where(F.col("split") == "test"), fx.REG_WEIGHTS, 0.0,
                               background=r.where(F.col("split") == "train"))


@register("linear_shap", with_views("SELECT id, feature, round(phi, 6) AS phi, round(base, 6) AS base FROM ph",
                                    "reg", ctes=_LSHAP))
def linear_shap(spark, d):
    return rounded(_linear_phi(spark, d))


@register("shap_global", with_views("SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM ph "
                                    "GROUP BY feature", "reg", ctes=_LSHAP))
def shap_global(spark, d):
    return rounded(explain.shap_global(_linear_phi(spark, d)))


@register("shap_local", with_views("SELECT id, feature, round(phi, 6) AS phi, round(base, 6) AS base FROM ph "
                                   "WHERE id = (SELECT min(id) FROM t)", "reg", ctes=_LSHAP))
def shap_local(spark, d):
    phi = _linear_phi(spark, d)
    first = fx.reg(spark, d).where(F.col("split") == "test").agg(F.min("id")).first()[0]
    return rounded(explain.shap_local(phi, first))


_MULTI_FEATS = ["f1", "f2", "f3"]
_MULTI_S = ["(0.5::DOUBLE + f1 / 500000.0::DOUBLE)", "1.0::DOUBLE", "(0.2::DOUBLE + f3 / 10.0::DOUBLE)"]
_MULTI_P = [f"{x} / ({' + '.join(_MULTI_S)})" for x in _MULTI_S]


def _sampled_sql(view: str, feats, scores, key: str, samples: int = 32) -> str:
    """Views t (explained rows) and ph (id, feature, cls, phi) of ``explain.sampled_shap``."""
    k = len(feats)
    order = [H(f"{key}, m, '{f}'", "ord:0") for f in feats]
    before = [" + ".join(f"CAST(u{j} {'<=' if j < i else '<'} u{i} AS INT)" for j in range(k) if j != i) or "0" for i in range(k)]
    at = ", ".join(f"at{i}" for i in range(k))
    walk = ", ".join(f"CASE WHEN at{i} < s THEN {f} ELSE z{i} END AS {f}" for i, f in enumerate(feats))
    rows = " UNION ALL ".join(
        f"SELECT id, '{f}' AS feature, {c} AS cls, sum((CAST(s = at{i} + 1 AS INT) - CAST(s = at{i} AS INT)) * v{c}) / {samples}.0 AS phi FROM sc GROUP BY id"
        for i, f in enumerate(feats) for c in range(len(scores)))
    return f"""
t AS (SELECT * FROM {view} WHERE split = 'test'),
bg AS (SELECT {", ".join(f"{f} AS z{i}" for i, f in enumerate(feats))}, row_number() OVER (ORDER BY {H(key, 'bgn:0')}, id) - 1 AS zi
       FROM {view} WHERE split = 'train'),
sm AS (SELECT id, {", ".join(feats)}, m, {", ".join(f"{u} AS u{i}" for i, u in enumerate(order))},
              CAST(floor(('0x' || substr(md5(concat_ws(':', 'bg:0', {key}, m)), 1, 15))::BIGINT / {float(1 << 60)!r}::DOUBLE * nb) AS BIGINT) AS zi
       FROM t CROSS JOIN (SELECT unnest(range(1, {samples + 1})) AS m) ms CROSS JOIN (SELECT count(*) AS nb FROM bg) n),
po AS (SELECT sm.*, bg.* EXCLUDE (zi), {", ".join(f"{x} AS at{i}" for i, x in enumerate(before))} FROM sm JOIN bg ON sm.zi = bg.zi),
st AS (SELECT id, s, {at}, {walk} FROM po CROSS JOIN (SELECT unnest(range({k + 1})) AS s) ss),
sc AS (SELECT id, s, {at}, {", ".join(f"{v} AS v{c}" for c, v in enumerate(scores))} FROM st),
ph AS ({rows})
"""


_MULTI_PHI = _sampled_sql("multi", _MULTI_FEATS, _MULTI_P, "CAST(id AS VARCHAR)")


@register("sampled_shap", with_views("SELECT id, feature, round(phi, 6) AS phi FROM ph", "clf",
                                     ctes=_sampled_sql("clf", _FEATS, [CLF_P], "id")))
def sampled_shap(spark, d):
    c = fx.clf(spark, d)
    return rounded(explain.sampled_shap(c.where(F.col("split") == "test"), fx.clf_scorer(), _FEATS,
                                        background=c.where(F.col("split") == "train"), background_id="id"))


def _multi_phi(spark, d):
    m = fx.multi(spark, d)
    test = m.where(F.col("split") == "test")
    return test, explain.sampled_shap(test, fx.multi_scorer(), _MULTI_FEATS, background=m.where(F.col("split") == "train"), background_id="id")


@register("sampled_shap_classes", with_views("SELECT id, feature, cls, round(phi, 6) AS phi FROM ph", "multi", ctes=_MULTI_PHI))
def sampled_shap_classes(spark, d):
    return rounded(_multi_phi(spark, d)[1])


@register("shap_global_classes", with_views("""
SELECT feature, round(sum(m), 6) AS mean_abs_phi FROM (SELECT feature, cls, avg(abs(phi)) AS m FROM ph GROUP BY feature, cls) c GROUP BY feature""",
                                            "multi", ctes=_MULTI_PHI))
def shap_global_classes(spark, d):
    return rounded(explain.shap_global(_multi_phi(spark, d)[1], by_class=True))


@register("shap_predicted_class", with_views(f"""
SELECT t.id, ph.cls, ph.feature, round(CASE ph.feature WHEN 'f1' THEN f1 WHEN 'f2' THEN f2 ELSE f3 END, 6) AS data, round(phi, 6) AS phi,
       round(CASE yh WHEN 0 THEN {_MULTI_P[0]} WHEN 1 THEN {_MULTI_P[1]} ELSE {_MULTI_P[2]} END - sum(phi) OVER (PARTITION BY ph.id, ph.cls), 6) AS base
FROM t JOIN ph ON t.id = ph.id AND ph.cls = t.yh""", "multi", ctes=_MULTI_PHI))
def shap_predicted_class(spark, d):
    test, phi = _multi_phi(spark, d)
    return rounded(explain.shap_predicted(phi, test, fx.multi_scorer(), _MULTI_FEATS))


@register("lime")
def lime(spark, d):
    c = fx.clf(spark, d)
    return rounded(explain.lime(c.where(F.col("split") == "test"), fx.clf_scorer(), _FEATS, train=c.where(F.col("split") == "train")))


@register("lime_classes")
def lime_classes(spark, d):
    m = fx.multi(spark, d)
    return rounded(explain.lime(m.where(F.col("split") == "test"), fx.multi_scorer(), _MULTI_FEATS, train=m.where(F.col("split") == "train")))


# ------------------------------------------------------- partial dependence

_PDP_P = "f2 / 120000.0 * 0.5 + f1 / 100.0"


def _pdp_scorer():
    return Scorer.from_columns(p=F.col("f2") / F.lit(120000.0) * F.lit(0.5) + F.col("f1") / F.lit(100.0))


@register("pdp_one_way", with_views(f"""
SELECT 'f2' AS feature_1, round(g.v, 6) AS value_1, round(avg({_PDP_P.replace("f2", "g.v")}), 6) AS average
FROM t CROSS JOIN (SELECT CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99.0) + lo END AS v
                   FROM (SELECT quantile_cont(f2, 0.05) AS lo, quantile_cont(f2, 0.95) AS hi FROM t) q
                   CROSS JOIN (SELECT unnest(range(100)) AS i) r) g
GROUP BY g.v""", "clf", ctes=_TEST))
def pdp_one_way(spark, d):
    return rounded(explain.partial_dependence(_clf_test(spark, d), _pdp_scorer(), "f2"))


@register("pdp_two_way", with_views(f"""
SELECT 'f1' AS feature_1, 'f3' AS feature_2, round(g1.v, 6) AS value_1, round(g2.v, 6) AS value_2,
       round(avg({CLF_P.replace("f1", "g1.v").replace("f3", "g2.v")}), 6) AS average
FROM t CROSS JOIN (SELECT DISTINCT f1 AS v FROM t) g1 CROSS JOIN (SELECT DISTINCT f3 AS v FROM t) g2
GROUP BY g1.v, g2.v""", "clf", ctes=_TEST))
def pdp_two_way(spark, d):
    return rounded(explain.partial_dependence(_clf_test(spark, d), fx.clf_scorer(), ["f1", "f3"]))


# ------------------------------------------------------------------ overfit

@register("noise_sensitivity", with_views(f"""
SELECT feat AS feature, 'ACC' AS metric, round(score, 6) AS score, round(base - score, 6) AS drop,
       CAST(base - score > 0.02 AS BIGINT) AS sensitive
FROM (SELECT feat, avg(CASE WHEN y = CASE WHEN p >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS score
      FROM (SELECT feat, y, {CLF_P} AS p FROM (
              SELECT feat, y, {", ".join(
                  f"CASE WHEN feat = '{c}' THEN {c} + z * 0.1 * coalesce(nullif(s{i}, 0), 1.0) ELSE {c} END AS {c}"
                  for i, c in enumerate(_FEATS))}
              FROM (SELECT t2.*, feat, CASE feat WHEN 'f1' THEN z0 WHEN 'f2' THEN z1 WHEN 'f3' THEN z2
                                                  ELSE z3 END AS z
                    FROM (SELECT t.*, {", ".join(f"{g} AS z{i}" for i, g in enumerate(G("id", "noise:42", 4)))}
                          FROM t) t2
                    CROSS JOIN (SELECT unnest(['f1', 'f2', 'f3', 'f4']) AS feat) fs) nz
              CROSS JOIN (SELECT {", ".join(f"stddev_samp({c}) AS s{i}" for i, c in enumerate(_FEATS))} FROM t) sd
            ) pt) ps GROUP BY feat) sc
CROSS JOIN (SELECT avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS base FROM t) b""", "clf", ctes=_TEST))
def noise_sensitivity(spark, d):
    return rounded(overfit.noise_sensitivity(_clf_test(spark, d), fx.clf_scorer(), _FEATS))


_GAP = """
ss AS (SELECT split, avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS acc,
              sum(CASE WHEN y = 1 AND yh = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN y = 0 AND yh = 1 THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN y = 1 AND yh = 0 THEN 1 ELSE 0 END) AS fn FROM clf
       WHERE split IN ('train', 'test') GROUP BY split),
ad AS (SELECT split, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM clf
       WHERE split IN ('train', 'test') GROUP BY split, p),
ar AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS cn FROM ad),
aa AS (SELECT split, sum(pos * (cn - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM ar GROUP BY split),
m AS (SELECT 'Accuracy' AS metric, split, acc AS v FROM ss
      UNION ALL SELECT 'F1', split, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END
      FROM ss
      UNION ALL SELECT 'AUC', split, auc FROM aa),
w AS (SELECT metric, max(CASE WHEN split = 'train' THEN v END) AS tr, max(CASE WHEN split = 'test' THEN v END) AS te
      FROM m GROUP BY metric)
"""


@register("train_test_gap", with_views("""
SELECT metric, round(tr, 6) AS train, round(te, 6) AS test, round(tr - te, 6) AS gap,
       CAST(tr - te > 0.05 AS BIGINT) AS overfit FROM w""", "clf", ctes=_GAP))
def train_test_gap(spark, d):
    return rounded(overfit.train_test_gap(fx.clf(spark, d), "classification"))


@register("learning_curve")
def learning_curve(spark, d):
    c = fx.clf(spark, d).withColumn("label", F.col("y").cast("double"))
    est = train.make_pipeline("tree", "classification", _FEATS)
    return rounded(overfit.learning_curve(c, est, "classification"))


# --------------------------------------------------------------- robustness

_SIZES_SQL = ", ".join(f"({repr(s)}::DOUBLE, {i})" for i, s in enumerate(robust.DEFAULT_SIZES))
_RUNS = f"""
{_TEST},
vr AS (SELECT {", ".join(f"var_samp({c}) AS v{i}" for i, c in enumerate(_FEATS))} FROM t),
rn AS (SELECT t.*, sz.size, it.iteration, sz.si * 10 + it.iteration - 1 AS run FROM t
       CROSS JOIN (SELECT * FROM (VALUES {_SIZES_SQL}) s(size, si)) sz
       CROSS JOIN (SELECT unnest(range(1, 11)) AS iteration) it),
pt AS (SELECT size, iteration, y, {", ".join(
    f"{c} + {g} * size * v{i} AS {c}" for i, (c, g) in enumerate(zip(_FEATS, G("id, run", "raw:0", 4))))}
       FROM rn CROSS JOIN vr),
runs AS (SELECT size, iteration,
                avg(CASE WHEN y = CASE WHEN p >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS value
         FROM (SELECT *, {CLF_P} AS p FROM pt) x GROUP BY size, iteration)
"""


_RUNS_AUC = _RUNS[:_RUNS.index("runs AS (")] + f"""
rr AS (SELECT size, iteration, y, rank() OVER (PARTITION BY size, iteration ORDER BY p)
              + (count(*) OVER (PARTITION BY size, iteration, p) - 1) / 2.0 AS r FROM (SELECT *, {CLF_P} AS p FROM pt) x),
runs AS (SELECT size, iteration, (sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS value
         FROM rr GROUP BY size, iteration)
"""


@register("robustness_runs", with_views("""
SELECT round(size, 6) AS size, iteration, 'ACC' AS metric, round(value, 6) AS value FROM runs""",
                                        "clf", ctes=_RUNS))
def robustness_runs(spark, d):
    return rounded(robust.robustness_runs(_clf_test(spark, d), fx.clf_scorer(), _FEATS, metric="ACC"))


@register("robustness_summary", with_views("""
SELECT round(size, 6) AS size, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
       round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM runs GROUP BY size""", "clf", ctes=_RUNS_AUC))
def robustness_summary(spark, d):
    runs = robust.robustness_runs(_clf_test(spark, d), fx.clf_scorer(), _FEATS, metric="AUC")
    return rounded(robust.robustness_summary(runs))


_CU = U("r.id, r.run", "cat:0", 2)


@register("category_noise", with_views(f"""
SELECT round(size, 6) AS size, iteration, lang, count(*) AS n FROM (
  SELECT r.size, r.iteration,
         CASE WHEN {_CU[0]} < r.size
              THEN (SELECT c.lang FROM cum c WHERE {_CU[1]} >= c.lo AND {_CU[1]} < c.hi)
              ELSE r.lang END AS lang
  FROM (SELECT docs.id, docs.lang, sz.size, it.iteration, sz.si * 10 + it.iteration - 1 AS run FROM docs
        CROSS JOIN (SELECT * FROM (VALUES {_SIZES_SQL}) s(size, si)) sz
        CROSS JOIN (SELECT unnest(range(1, 11)) AS iteration) it) r) x
GROUP BY size, iteration, lang""", "docs", ctes="""
fq AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang),
cum AS (SELECT lang, (sum(n) OVER (ORDER BY lang) - n) / (SELECT sum(n) FROM fq) AS lo,
               sum(n) OVER (ORDER BY lang) / (SELECT sum(n) FROM fq) AS hi FROM fq)
"""))
def category_noise(spark, d):
    docs = fx.docs(spark, d).select("id", "lang")
    runs = robust.explode_runs(docs, robust.DEFAULT_SIZES, 10)
    out = robust.category_noise(runs, ["lang"], "id", seed=0, stats_from=docs)
    return rounded(out.groupBy("size", "iteration", "lang").agg(F.count(F.lit(1)).alias("n")))


@register("quantile_noise", with_views(f"""
SELECT round(size, 6) AS size, iteration, round(avg(val), 6) AS mean_f2, round(min(val), 6) AS min_f2,
       round(max(val), 6) AS max_f2 FROM (
  SELECT size, iteration, CASE WHEN tt >= 0.5 THEN vb - (vb - va) * (1.0 - tt) ELSE va + (vb - va) * tt END AS val
  FROM (SELECT q.size, q.iteration, pos - floor(pos) AS tt, a.v AS va, b.v AS vb
        FROM (SELECT size, iteration, least(greatest(pct + ({U("id, si * 10 + iteration - 1", 'qn:0:f2', 1)[0]}
                                                             * 2.0 - 1.0) * size, 0.0), 1.0) * (n - 1) AS pos
              FROM pc CROSS JOIN (SELECT * FROM (VALUES {_SIZES_SQL}) s(size, si)) sz
              CROSS JOIN (SELECT unnest(range(1, 11)) AS iteration) it) q
        LEFT JOIN srt a ON a.k = CAST(floor(q.pos) AS BIGINT) + 1
        LEFT JOIN srt b ON b.k = CAST(ceil(q.pos) AS BIGINT) + 1) j) v
GROUP BY size, iteration""", "reg", ctes="""
t AS (SELECT * FROM reg WHERE split = 'test'),
pc AS (SELECT id, (rank() OVER (ORDER BY f2) + (count(*) OVER (PARTITION BY f2) - 1) / 2.0) / count(*) OVER () AS pct,
              count(*) OVER () AS n FROM t),
srt AS (SELECT f2 AS v, row_number() OVER (ORDER BY f2) AS k FROM t)
"""))
def quantile_noise(spark, d):
    t = fx.reg(spark, d).where(F.col("split") == "test").select("id", "f2")
    base = robust.with_percentile(t, "f2", "_pct")
    runs = robust.explode_runs(base, robust.DEFAULT_SIZES, 10)
    out = robust.quantile_noise(runs, t, "f2", "_pct", "id", seed=0)
    return rounded(out.groupBy("size", "iteration").agg(
        F.avg("f2").alias("mean_f2"), F.min("f2").alias("min_f2"), F.max("f2").alias("max_f2")))


# ---------------------------------------------------------------- weak spots

def _segment_sql(features, depth: int = 3) -> str:
    """Views n<depth> (rows with their node) and nm (leaf number by node) of the exact entropy tree."""
    bits = lambda n, k: " - ".join(f"CASE WHEN {x} > 0 THEN ({x}) * log2({x}) ELSE 0 END" for x in (n, k, f"({n} - {k})"))
    out = ["n0 AS (SELECT *, CASE WHEN y = yh THEN 1 ELSE 0 END AS ok, 1 AS node FROM t)"]
    for i in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {k} AS f, {f} AS v, ok FROM n{i}" for k, f in enumerate(features))
        value = "CASE f " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(features)) + " END"
        out.append(f"""
v{i} AS (SELECT node, f, v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(ok) AS DOUBLE) AS k FROM ({long}) GROUP BY node, f, v),
r{i} AS (SELECT node, f, v, lead(v) OVER w AS nv, sum(n) OVER u AS cn, sum(k) OVER u AS ck,
                sum(n) OVER (PARTITION BY node, f) AS nn, sum(k) OVER (PARTITION BY node, f) AS kk
         FROM v{i} WINDOW w AS (PARTITION BY node, f ORDER BY v), u AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING)),
b{i} AS (SELECT node, f, CASE WHEN (v + nv) / 2 < nv THEN (v + nv) / 2 ELSE v END AS thr FROM (
           SELECT *, row_number() OVER (PARTITION BY node ORDER BY round({bits("cn", "ck")} + {bits("(nn - cn)", "(kk - ck)")}, 6), f, v) AS place
           FROM r{i} WHERE nv IS NOT NULL AND kk > 0 AND kk < nn AND node >= {1 << i}) WHERE place = 1),
n{i + 1} AS (SELECT n{i}.* REPLACE (CASE WHEN thr IS NULL THEN node ELSE 2 * node + CASE WHEN {value} > thr THEN 1 ELSE 0 END END AS node)
             FROM n{i} LEFT JOIN b{i} USING (node))""")
    at = f"node * (1 << ({depth} - CAST(floor(log2(node)) AS INT)))"
    out.append(f"\nnm AS (SELECT node, row_number() OVER (ORDER BY {at}) - 1 AS leaf FROM (SELECT DISTINCT node FROM n{depth}))")
    return _TEST + ",\n" + ",".join(out)


def _leaf_sql(features, threshold: float, depth: int = 3) -> str:
    ranges = ", ".join(f"round(min({f}), 6) AS {f}_min, round(max({f}), 6) AS {f}_max" for f in features)
    return f"""
SELECT leaf, {ranges}, count(*) AS count, round(count(*) / max(al) * 100.0, 6) AS share_pct, round(avg(ok), 6) AS accuracy,
       round(max(base), 6) AS overall_accuracy, CAST(count(*) >= 5 AND max(base) - avg(ok) > {threshold} AS BIGINT) AS weak
FROM n{depth} JOIN nm USING (node) CROSS JOIN (SELECT count(*) AS al, avg(ok) AS base FROM n0) o GROUP BY leaf"""


@register("weak_segments", with_views(_leaf_sql(["f1", "f3"], 0.1), "clf", ctes=_segment_sql(["f1", "f3"])))
def weak_segments(spark, d):
    return rounded(weakspot.weak_segments(_clf_test(spark, d), ["f1", "f3"], threshold=0.1))


@register("weak_segments_one_way", with_views(_leaf_sql(["f2"], 0.05), "clf", ctes=_segment_sql(["f2"])))
def weak_segments_one_way(spark, d):
    return rounded(weakspot.weak_segments(_clf_test(spark, d), ["f2"], threshold=0.05))


@register("segment_rows", with_views("""
SELECT id, leaf, round(accuracy, 6) AS segment_accuracy
FROM n3 JOIN nm USING (node) JOIN (SELECT node, avg(ok) AS accuracy, count(*) AS c FROM n3 GROUP BY node) a USING (node) WHERE c >= 5""",
                                     "clf", ctes=_segment_sql(["f1", "f3"])))
def segment_rows(spark, d):
    c = weakspot.correctness(_clf_test(spark, d))
    leaves = weakspot.assign_leaves(c, weakspot.segment_tree(c, ["f1", "f3"]))
    out = weakspot.rows_with_segment(leaves, weakspot.leaf_table(leaves, ["f1", "f3"]))
    return rounded(out.select("id", "leaf", "segment_accuracy"))


def _gap_rows(label: str, value: str) -> str:
    """One metric's train and test value per segment."""
    return (f"SELECT f1_bin, '{label}' AS metric, max(CASE WHEN split = 'train' THEN {value} END) AS train, "
            f"max(CASE WHEN split = 'test' THEN {value} END) AS test FROM sc GROUP BY f1_bin")


_SEGMENT_GAP = """
ed AS (SELECT list_sort(list_distinct(quantile_cont(f1, [{q}]))) AS e FROM clf),
sg AS (SELECT t.*, CASE WHEN f1 >= e[1] AND f1 <= e[len(e)] THEN len(list_filter(e[2:len(e) - 1], lambda x: x < f1)) + 1 END AS f1_bin
       FROM clf t CROSS JOIN ed WHERE split IN ('train', 'test')),
rk AS (SELECT *, rank() OVER (PARTITION BY f1_bin, split ORDER BY p)
              + (count(*) OVER (PARTITION BY f1_bin, split, p) - 1) / 2.0 AS r FROM sg),
sc AS (SELECT f1_bin, split, avg(CASE WHEN y = yh THEN 1.0 ELSE 0.0 END) AS acc,
              2.0 * sum(CASE WHEN y = 1 AND yh = 1 THEN 1 ELSE 0 END)
              / nullif(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) + sum(CASE WHEN yh = 1 THEN 1 ELSE 0 END), 0) AS f1m,
              (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
              / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
       FROM rk GROUP BY f1_bin, split),
gp AS ({rows})
""".format(q=", ".join(repr(1.0 if i == 10 else i * 0.1) for i in range(11)),
           rows=" UNION ALL ".join((_gap_rows("Accuracy", "acc"), _gap_rows("AUC", "auc"), _gap_rows("F1", "coalesce(f1m, 0)"))))


@register("segment_gap", with_views("""
SELECT f1_bin, metric, round(train, 6) AS train, round(test, 6) AS test, round(train - test, 6) AS gap, train - test > 0.05 AS overfit
FROM gp""", "clf", ctes=_SEGMENT_GAP))
def segment_gap(spark, d):
    from probity.operators.resilience import decile_bins
    c = decile_bins(fx.clf(spark, d), "f1", out="f1_bin")
    return rounded(overfit.train_test_gap(c, "classification", by="f1_bin"))


# ------------------------------------------------------------------ training

@register("class_weights", with_views("""
SELECT y, count(*) AS n, round(max(cnt_all) / (2.0 * count(*)), 6) AS weight
FROM (SELECT y, count(*) OVER () AS cnt_all FROM clf WHERE split = 'train') t GROUP BY y""", "clf"))
def class_weights(spark, d):
    tr = fx.clf(spark, d).where(F.col("split") == "train")
    w = train.class_weights(tr, "y")
    return rounded(w.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))


def _board(spark, d, task):
    if task == "classification":
        src = fx.clf(spark, d)
        names = ["logistic", "tree", "forest", "gbm"]
    else:
        src = fx.reg(spark, d)
        names = ["linear", "tree", "forest", "gbm"]
    models, scored = train.train_models(src.where(F.col("split") == "train"), src.where(F.col("split") == "test"),
                                        names, task, _FEATS)
    return train.leaderboard(scored, task, n_features=len(_FEATS))


@register("leaderboard_classification")
def leaderboard_classification(spark, d):
    return rounded(_board(spark, d, "classification"))


@register("leaderboard_regression")
def leaderboard_regression(spark, d):
    return rounded(_board(spark, d, "regression"))


@register("registered_models")
def registered_models(spark, d):
    return rounded(train.register_models(_board(spark, d, "classification"), ["forest", "gbm"]))


@register("worst_cluster")
def worst_cluster_k(spark, d):
    return rounded(worst_cluster(_clf_test(spark, d), _FEATS, 3, "ACC", n_init=10))


# -------------------------------------------------------------------- presets

@register("preset_sample", with_views(f"""
SELECT id, l_quantity, l_extendedprice, l_discount, l_returnflag FROM nul
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL
  AND l_returnflag IS NOT NULL
ORDER BY {H('id', 'sample:42')}, id LIMIT 30000""", "nul"))
def preset_sample(spark, d):
    spec = files.DatasetSpec("nul", "classification", "l_returnflag", None, None, "lineitem with nulls",
                             "lineitem", drop=("l_linestatus", "absent_column"), sample=30_000)
    return rounded(files.prepare_preset(fx.nul(spark, d), spec))
