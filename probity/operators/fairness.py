"""Group fairness: adverse impact ratio, precision ratio, standardised mean
difference (N1-N8).

The reference predicts again for every (feature, class) pair.  Here all protected
attributes are reshaped long once and grouped by (feature, class); the reference
group of a class is "everyone else" = feature total − class, so every pair comes
out of one aggregation pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.util import as_col, count_if, safe_div
from probity.operators.resilience import decile_edges, label_with_edges


def attribute_labels(df: DataFrame, attributes, edges_from: DataFrame | None = None) -> DataFrame:
    """One string label column per attribute: the category itself, or the decile
    bin 1..B of a numeric attribute with edges on ``edges_from`` (all data) (N1, N3).
    Edges of all numeric attributes come from one quantile pass."""
    numeric = [a for a in attributes if isinstance(df.schema[a].dataType, T.NumericType)]
    out = df
    if numeric:
        src = (edges_from if edges_from is not None else df).select(*[as_col(a) for a in numeric])
        out = out.crossJoin(F.broadcast(decile_edges(src, numeric)))
    for k, a in enumerate(attributes):      # label columns are numbered: names may hold dots
        if a in numeric:
            i = numeric.index(a)
            out = label_with_edges(out, a, f"_e_{i}", f"_lab{k}")
            out = out.withColumn(f"_lab{k}", F.col(f"_lab{k}").cast("string"))
        else:
            out = out.withColumn(f"_lab{k}", as_col(a).cast("string"))
    return out.drop(*[f"_e_{i}" for i in range(len(numeric))])


def group_table(df: DataFrame, attributes, y="y", yh="yh", edges_from: DataFrame | None = None) -> DataFrame:
    """Per (feature, class): n, selections, TP, FP with their feature totals, and count,
    mean and squared deviations (n_pred, mean, m2) of the prediction (N2, N7)."""
    attributes = list(attributes)
    lab = attribute_labels(df, attributes, edges_from)
    pred, truth = as_col(yh).cast("double"), as_col(y)
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("feature"), F.col(f"_lab{k}").alias("cls"))
                                for k, a in enumerate(attributes)]))
    long = lab.select(stack.alias("_g"), pred.alias("_p"), truth.alias("_t")).select("_g.*", "_p", "_t")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_p").alias("sel"),
            count_if((F.col("_p") == 1) & (F.col("_t") == 1)).alias("tp"),
            count_if((F.col("_p") == 1) & (F.col("_t") == 0)).alias("fp"),
            F.count("_p").alias("n_pred"), F.avg("_p").alias("mean"),
            (F.var_pop("_p") * F.count("_p")).alias("m2")]
    per = long.groupBy("feature", "cls").agg(*aggs)
    tot = per.groupBy("feature").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sel", "tp", "fp")])
    return per.join(F.broadcast(tot), "feature")


def fairness_ratios(df: DataFrame, attributes, y="y", yh="yh", edges_from: DataFrame | None = None,
                    drop_undefined: bool = True) -> DataFrame:
    """AIR and precision ratio for every (attribute, class) pair.

    Rows with no class (null, or outside the bins) belong to the reference group.
    """
    g = group_table(df, attributes, y, yh, edges_from).where(F.col("cls").isNotNull())
    n_p, n_r = F.col("n"), F.col("t_n") - F.col("n")
    sel_p, sel_r = F.col("sel"), F.col("t_sel") - F.col("sel")
    tp_p, tp_r = F.col("tp"), F.col("t_tp") - F.col("tp")
    fp_p, fp_r = F.col("fp"), F.col("t_fp") - F.col("fp")
    rate_p = safe_div(sel_p, n_p)
    rate_r = safe_div(sel_r, n_r)
    air = F.when((n_p > 0) & (n_r > 0), safe_div(rate_p, rate_r))
    ppv_p = F.when(tp_p + fp_p > 0, tp_p / (tp_p + fp_p))
    ppv_r = F.when(tp_r + fp_r > 0, tp_r / (tp_r + fp_r))
    out = g.select("feature", "cls", n_p.cast("bigint").alias("n_protected"), n_r.cast("bigint").alias("n_reference"),
                   rate_p.alias("selection_protected"), rate_r.alias("selection_reference"), air.alias("air"),
                   ppv_p.alias("ppv_protected"), ppv_r.alias("ppv_reference"), safe_div(ppv_p, ppv_r).alias("pr"))
    return out.where(F.col("air").isNotNull()) if drop_undefined else out


def standardized_mean_difference(df: DataFrame, attributes, yh="yh",
                                 edges_from: DataFrame | None = None) -> DataFrame:
    """SMD of the prediction, protected vs everyone else, pooled std (n−1).

    Counts, means and squared deviations of the classes are merged around the mean of the
    whole attribute: no sums of squares far from zero are subtracted, so predictions near
    1e9 keep their digits.
    """
    g = group_table(df.withColumn("_y0", F.lit(0)), attributes, "_y0", yh, edges_from)
    g = g.select("feature", "cls", F.col("n_pred").alias("n"), "mean", "m2").where("n > 0")
    centre = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    d = F.col("mean") - F.col("centre")
    own = g.join(F.broadcast(centre), "feature").withColumn("d", d) \
           .withColumn("ss", F.col("m2") + F.col("n") * F.col("d") * F.col("d"))   # around the centre
    tot = own.groupBy("feature").agg(F.sum("n").alias("t_n"), F.sum(F.col("n") * F.col("d")).alias("t_d"), F.sum("ss").alias("t_ss"))
    j = own.where(F.col("cls").isNotNull()).join(F.broadcast(tot), "feature")
    n_p, n_r = F.col("n"), F.col("t_n") - F.col("n")
    d_r = safe_div(F.col("t_d") - n_p * F.col("d"), n_r)                     # other classes' mean − centre
    ss_r = F.greatest(F.col("t_ss") - F.col("ss") - n_r * F.coalesce(d_r * d_r, F.lit(0.0)), F.lit(0.0))
    pooled = F.sqrt(safe_div(F.col("m2") + ss_r, n_p + n_r - F.lit(2)))
    return j.select("feature", "cls", n_p.cast("bigint").alias("n_protected"), n_r.cast("bigint").alias("n_reference"),
                    F.col("mean").alias("mean_protected"), (F.col("centre") + d_r).alias("mean_reference"),
                    safe_div(F.col("d") - d_r, pooled).alias("smd"))
