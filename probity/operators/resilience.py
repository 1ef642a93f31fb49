"""Resilience: drift distances, worst samples and worst clusters.

Distances for all features are computed in one long (feature, value) pass.  The worst
samples come from a threshold search (``top_levels``): counts per residual bucket say
where each share ends, and only rows of those buckets are ranked.  The alpha sweep gives
each row the first level it belongs to and widens grouped counts, not rows, to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.binning import bin_index, even_bin_index, scaled_edges
from probity.functions.util import as_col
from probity.operators.cluster import Clusters, assign_clusters, fit_clusters
from probity.operators.metrics import LOWER_IS_BETTER, auc_of_counts, evaluate
from probity.plans.ordering import running_sums, top_levels
from probity.plans.quantiles import exact_quantiles
from probity.plans.reshape import bounded_broadcast, to_long
from probity.session import cut_lineage

PSI_FLOOR = 0.0001


# ------------------------------------------------------------------------ PSI

def _psi_edges(expected: DataFrame, features, buckets: int, kind: str) -> DataFrame:
    """One row with the bin edges of feature i in column ``_e<i>``."""
    if kind == "bins":
        lows_highs = expected.agg(*[x for i, f in enumerate(features) for x in (F.min(as_col(f).cast("double")).alias(f"_lo{i}"),
                                                                                 F.max(as_col(f).cast("double")).alias(f"_hi{i}"))])
        return lows_highs.select(*[scaled_edges(f"_lo{i}", f"_hi{i}", buckets).alias(f"_e{i}") for i in range(len(features))])
    if kind != "quantiles":
        raise ValueError(kind)
    qs = [(i / buckets * 100) / 100 for i in range(buckets + 1)]
    q = exact_quantiles(to_long(expected, [], features), "value", qs, ["feature"], max_groups=len(features))
    per = q.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "quantile"))), lambda s: s["quantile"]).alias("_e"))
    return per.agg(*[F.max(F.when(F.col("feature") == f, F.col("_e"))).alias(f"_e{i}") for i, f in enumerate(features)])


def psi(df: DataFrame, features, side: str = "side", expected="expected", actual="actual",
        buckets: int = 10, kind: str = "bins") -> DataFrame:
    """Population stability index per feature (K1, K2).

    ``df`` holds both samples, told apart by ``side``.  Edges come from the
    expected sample: equal-width over its [min, max] (``bins``) or its percentiles
    (``quantiles``).  Shares are over the full sample size, values outside the
    edges are left out of the counts, an empty share counts as 0.0001, and
    PSI = Σ (e − a)·ln(e / a).
    """
    features = list(features)
    edges = _psi_edges(df.where(F.col(side) == F.lit(expected)), features, buckets, kind)
    edges = edges.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_e{i}").alias("_e")) for i, f in enumerate(features)])).alias("_x")) \
                 .select("_x.feature", "_x._e").where(F.col("_e")[0].isNotNull())  # no edges without expected values
    spot = even_bin_index if kind == "bins" else bin_index
    binned = to_long(df, [side], features).join(bounded_broadcast(edges, len(features)), "feature").select(
        "feature", F.col(side).alias("_side"), F.coalesce(spot("value", "_e", buckets), F.lit(-1)).alias("bin"))  # -1: outside; no null, so that both uses of the counts share one plan
    counts = binned.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("_side") == expected, 1).otherwise(0)).alias("_ce"),
        F.sum(F.when(F.col("_side") == actual, 1).otherwise(0)).alias("_ca"))
    # sample sizes from the (feature × bin) table, null bin included: no second scan
    n = counts.groupBy("feature").agg(F.sum("_ce").alias("_ne"), F.sum("_ca").alias("_na"))
    grid = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bin"))
    j = grid.join(counts, ["feature", "bin"], "left")
    e = F.try_divide(F.col("_ce"), F.col("_ne"))
    a = F.try_divide(F.col("_ca"), F.col("_na"))
    e = F.when(F.coalesce(F.col("_ce"), F.lit(0)) == 0, F.lit(PSI_FLOOR)).otherwise(e)
    a = F.when(F.coalesce(F.col("_ca"), F.lit(0)) == 0, F.lit(PSI_FLOOR)).otherwise(a)
    return j.groupBy("feature").agg(F.sum((e - a) * F.log(e / a)).alias("psi"))


# ---------------------------------------------------------- WD1 and KS

def distribution_distances(df: DataFrame, features, side: str = "side", a="expected", b="actual") -> DataFrame:
    """Wasserstein-1 and the two-sample KS statistic per feature, from empirical CDFs.

    Per distinct (feature, value): F = cumA/nA, G = cumB/nB;
    WD1 = Σ |F − G|·(next value − value), KS = max |F − G|.
    """
    features = list(features)
    long = to_long(df, [side], features).where(F.col("value").isNotNull())
    w = long.select("feature", "value",
                    F.when(F.col(side) == a, 1).otherwise(0).cast("bigint").alias("ca"),
                    F.when(F.col(side) == b, 1).otherwise(0).cast("bigint").alias("cb"))
    rs = running_sums(w, "value", ["ca", "cb"], ["feature"])
    n = w.groupBy("feature").agg(F.sum("ca").alias("_na"), F.sum("cb").alias("_nb"))
    j = rs.join(bounded_broadcast(n, len(features)), "feature")
    diff = F.abs(F.try_divide(F.col("cum_ca"), F.col("_na")) - F.try_divide(F.col("cum_cb"), F.col("_nb")))
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return j.groupBy("feature").agg(F.sum(diff * step).alias("wasserstein"), F.max(diff).alias("ks"))


# ------------------------------------------------------------- worst samples

def residual_column(df: DataFrame, task: str = "classification", y="y", p="p", yh="yh", probs=None,
                    out: str = "residual") -> DataFrame:
    """|p − y| (binary), 1 − p[true] (multi-class, Q13), |y − yh| (regression)."""
    if task == "regression":
        r = F.abs(as_col(y).cast("double") - as_col(yh).cast("double"))
    elif probs is not None:
        r = F.lit(1.0) - F.element_at(as_col(probs), as_col(y).cast("int") + 1)
    else:
        r = F.abs(as_col(p).cast("double") - as_col(y).cast("double"))
    return df.withColumn(out, r)


def decile_edges(src: DataFrame, features, q: int = 10) -> DataFrame:
    """One row: for every feature, ``pd.qcut``-style edges = linear quantiles at
    linspace(0, 1, q+1) with duplicates dropped, as column ``_e_<i>`` (one pass for all
    features over the long reshape)."""
    features = list(features)
    qs = [1.0 if i == q else i * (1.0 / q) for i in range(q + 1)]
    long = to_long(src, [], features).where(F.col("value").isNotNull())
    qt = exact_quantiles(long, "value", qs, ["feature"], max_groups=len(features))
    per = qt.groupBy("feature").agg(F.array_distinct(F.array_sort(F.collect_list("quantile"))).alias("_e"))
    return per.agg(*[F.max(F.when(F.col("feature") == f, F.col("_e"))).alias(f"_e_{i}")
                     for i, f in enumerate(features)])


def label_with_edges(df: DataFrame, feature: str, edges_col: str, out: str, include_lowest: bool = True):
    """Bin label 1..B of ``feature`` for (a, b] edges in ``edges_col``; null outside."""
    v = as_col(feature).cast("double")
    e = F.col(edges_col)
    inner = F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
    idx = F.size(F.filter(inner, lambda x: x < v)) + F.lit(1)
    lo, hi = F.element_at(e, 1), F.element_at(e, -1)
    ok = ((v >= lo) if include_lowest else (v > lo)) & (v <= hi) & (F.size(e) >= 2)
    return df.withColumn(out, F.when(v.isNotNull() & ok, idx))


def decile_bins(df: DataFrame, feature: str, q: int = 10, out: str = "bin", edges_from: DataFrame | None = None,
                include_lowest: bool = True) -> DataFrame:
    """``pd.qcut``-style bins: edges = linear quantiles at linspace(0, 1, q+1) of
    ``edges_from`` (default: ``df``), duplicates dropped, (a, b] with the lowest
    value included; label 1..B, null for values outside or null (N1, K7)."""
    src = edges_from if edges_from is not None else df
    edges = decile_edges(src.select(as_col(feature).alias(feature)), [feature], q)
    j = df.crossJoin(F.broadcast(edges))
    return label_with_edges(j, feature, "_e_0", out, include_lowest).drop("_e_0")


def _levels(df: DataFrame, cuts, residual: str, id_col: str, feature: str | None) -> DataFrame:
    """Rows that a level takes in, with ``level``; with ``feature``, levels are of each of its decile bins."""
    if feature is None:
        return top_levels(df, residual, id_col, cuts)
    base = decile_bins(df, feature, out="_bin").where(F.col("_bin").isNotNull())
    return top_levels(base, residual, id_col, cuts, ["_bin"], max_groups=10).drop("_bin")


def worst_samples(df: DataFrame, alpha: float = 0.1, residual: str = "residual", id_col: str = "id",
                  feature: str | None = None) -> DataFrame:
    """Rows with the int(alpha·n) largest residuals (K6); with ``feature``, the
    int(alpha·bin size) largest inside each decile bin of that feature (K7).
    Ties are broken by a hash of the id.  Rows with a null feature never qualify (Q23)."""
    return _levels(df, [lambda n: F.floor(F.lit(float(alpha)) * n)], residual, id_col, feature).drop("level")


def resilience_sweep(df: DataFrame, metric: str, alphas=10, residual: str = "residual", id_col: str = "id",
                     feature: str | None = None, **eval_kw) -> DataFrame:
    """Score on the worst floor(n·i/10) rows for i = 1..10, plus the overall score (K8, K9).

    Each row has the first level that takes it in.  Binary AUC counts labels per (first
    level, score) and hands these counts on to the higher levels; other metrics are plain
    grouped means, so their copies of a row never leave its task.
    """
    cuts = [lambda n, i=i: F.floor(n * F.lit(i) / F.lit(alphas)) for i in range(1, alphas + 1)]
    first = _levels(df, cuts, residual, id_col, feature)
    reach = F.explode(F.sequence(F.col("level"), F.lit(alphas)))
    if metric.upper() == "AUC" and eval_kw.get("probs") is None:
        label = F.when(as_col(eval_kw.get("y", "y")) == 1, 1).otherwise(0).cast("bigint")
        counts = first.groupBy("level", as_col(eval_kw.get("p", "p")).cast("double").alias("score")).agg(
            F.sum(label).alias("pos"), F.sum(F.lit(1).cast("bigint") - label).alias("neg"))
        scores = auc_of_counts(cut_lineage(counts).select(reach.alias("level"), "score", "pos", "neg"), ["level"]).select(
            "level", F.lit("AUC").alias("metric"), F.col("auc").cast("double").alias("value"))
    else:
        scores = evaluate(first.withColumn("level", reach), metric, by=["level"], **eval_kw)
    overall = evaluate(df, metric, **eval_kw).select(F.col("value").alias("overall"))
    alpha = (F.col("level") / F.lit(float(alphas))).alias("alpha")
    return scores.crossJoin(F.broadcast(overall)).select("level", alpha, "metric", "value", "overall")


def worst_vs_all_distance(df: DataFrame, worst: DataFrame, features, distance: str = "PSI",
                          top_k: int | None = None) -> DataFrame:
    """Distance of each feature between the worst rows and all rows."""
    features = list(features)
    both = df.select(*features, F.lit("expected").alias("side")).unionByName(
        worst.select(*features, F.lit("actual").alias("side")))
    if distance.upper() == "PSI":
        out = psi(both, features).withColumnRenamed("psi", "distance")
    else:
        dd = distribution_distances(both, features)
        out = dd.select("feature", F.col("wasserstein" if distance.upper() == "WD1" else "ks").alias("distance"))
    if top_k:
        out = out.orderBy(F.col("distance").desc(), "feature").limit(int(top_k))
    return out


# ------------------------------------------------------------ worst clusters

def _worst_first(metric: str):
    value = F.col("value")
    return value.asc_nulls_last() if metric.upper() not in LOWER_IS_BETTER else value.desc_nulls_last()


def cluster_scores(df: DataFrame, clusters: Clusters, metric: str = "AUC", **eval_kw) -> DataFrame:
    """(k, cluster, metric, value) of every cluster of every k, in one job."""
    assigned = assign_clusters(df, clusters).select("*", F.explode("clusters").alias("_c"))
    return evaluate(assigned.withColumn("k", F.col("_c.k")).withColumn("cluster", F.col("_c.cluster")), metric, by=["k", "cluster"], **eval_kw)


def worst_cluster(df: DataFrame, features, k: int, metric: str = "AUC", n_init: int = 10, seed: int = 0, id_col: str = "id",
                  **eval_kw) -> DataFrame:
    """K-means on standardised features (best of ``n_init`` starts), score per cluster, worst
    first (K3, K4).  Lower-is-better metrics pick the highest; undefined scores come last."""
    clusters = fit_clusters(df, features, [k], n_init, seed, id_col)
    return cluster_scores(df, clusters, metric, **eval_kw).select("cluster", "metric", "value", "k").orderBy(_worst_first(metric), "cluster")


def worst_cluster_rows(df: DataFrame, features, k: int, metric: str = "AUC", n_init: int = 10, seed: int = 0, id_col: str = "id",
                       **eval_kw) -> DataFrame:
    """Rows of the cluster with the worst score, with ``cluster``."""
    clusters = fit_clusters(df, features, [k], n_init, seed, id_col)
    worst = cluster_scores(df, clusters, metric, **eval_kw).orderBy(_worst_first(metric), "cluster").limit(1).select(F.col("cluster").alias("_worst"))  # one row
    rows = assign_clusters(df, clusters).withColumn("cluster", F.get("clusters", F.lit(0))["cluster"]).drop("clusters")
    return rows.join(F.broadcast(worst), F.col("cluster") == F.col("_worst"), "left_semi")


def worst_cluster_sweep(df: DataFrame, features, metric: str = "AUC", max_k: int = 10, n_init: int = 10, seed: int = 0, id_col: str = "id",
                        **eval_kw) -> DataFrame:
    """Worst-cluster score for k = 2..max_k next to the overall score (K5), all k fitted together."""
    clusters = fit_clusters(df, features, range(2, max_k + 1), n_init, seed, id_col)
    scores = cluster_scores(df, clusters, metric, **eval_kw)
    sign = -1.0 if metric.upper() in LOWER_IS_BETTER else 1.0
    key = F.struct(F.col("value").isNull().alias("none"), (F.lit(sign) * F.col("value")).alias("v"), "cluster")
    worst = scores.groupBy("k", "metric").agg(F.min_by(F.struct("cluster", "value"), key).alias("w"))
    overall = evaluate(df, metric, **eval_kw).select(F.col("value").alias("overall"))
    return worst.crossJoin(F.broadcast(overall)).select("k", "w.cluster", "metric", "w.value", "overall")


def time_slice_drift(df: DataFrame, ts: str, features, slice_duration: str = "1 day", metric: str | None = None,
                     **eval_kw) -> DataFrame:
    """Drift across time slices (V10): per slice, PSI of each feature against all
    rows, plus the model score per slice when ``metric`` is given."""
    features = list(features)
    sl = df.withColumn("slice", F.date_format(F.window(as_col(ts), slice_duration).start, "yyyy-MM-dd HH:mm"))
    # expected = all rows, actual = one slice; the slice is a group key, so every
    # slice is scored in the same pass (no loop over slices)
    long = to_long(sl, ["slice"], features)
    st = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    edges = bounded_broadcast(st.select("feature", scaled_edges("_lo", "_hi", 10).alias("_e")), len(features))
    b = long.join(edges, "feature").select("slice", "feature", bin_index("value", "_e", 10, "left").alias("bin"))
    all_counts = b.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("_ce"))
    sl_counts = b.groupBy("slice", "feature", "bin").agg(F.count(F.lit(1)).alias("_ca"))
    n_all = b.groupBy("feature").agg(F.count(F.lit(1)).alias("_ne"))
    n_sl = b.groupBy("slice", "feature").agg(F.count(F.lit(1)).alias("_na"))
    grid = n_sl.select("slice", "feature", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    j = grid.join(all_counts.where(F.col("bin").isNotNull()), ["feature", "bin"], "left") \
            .join(sl_counts.where(F.col("bin").isNotNull()), ["slice", "feature", "bin"], "left") \
            .join(n_all, "feature").join(n_sl, ["slice", "feature"])
    e = F.when(F.coalesce(F.col("_ce"), F.lit(0)) == 0, F.lit(PSI_FLOOR)).otherwise(F.col("_ce") / F.col("_ne"))
    a = F.when(F.coalesce(F.col("_ca"), F.lit(0)) == 0, F.lit(PSI_FLOOR)).otherwise(F.col("_ca") / F.col("_na"))
    out = j.groupBy("slice", "feature").agg(F.sum((e - a) * F.log(e / a)).alias("psi"),
                                              F.first("_na").alias("n"))
    if metric:
        sc = evaluate(sl, metric, by=["slice"], **eval_kw).select("slice", F.col("value").alias("score"))
        out = out.join(sc, "slice", "left")
    return out
