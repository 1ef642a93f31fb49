"""Feature selection by correlation and importance.

Scores for all features come from one pass (``agg`` of one expression per feature,
or a long reshape grouped by feature).  Removing features collects only the
feature names (schema-sized) and returns a new DataFrame; the previous one stays
valid, which is the revert (E8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.util import as_col, numeric_columns
from probity.plans.ordering import rank_table
from probity.plans.reshape import to_long


def pearson_target(df: DataFrame, target: str, features=None, threshold: float = 0.0) -> DataFrame:
    """Pearson r of each numeric feature with the target (E1) and the keep flag.

    Pairwise-complete rows; a constant feature gives null (kept: it is not known to
    be weak).  Stable ``covar_pop``/``var_pop`` aggregates, one pass.
    """
    features = features or numeric_columns(df, exclude=(target,))
    yv = as_col(target).cast("double")
    exprs = []
    for i, f in enumerate(features):
        x = as_col(f).cast("double")
        both = x.isNotNull() & yv.isNotNull()
        exprs += [F.covar_pop(F.when(both, x), F.when(both, yv)).alias(f"_c{i}"),
                  F.var_pop(F.when(both, x)).alias(f"_vx{i}"), F.var_pop(F.when(both, yv)).alias(f"_vy{i}")]
    agg = df.agg(*exprs)
    rows = [F.struct(F.lit(f).alias("feature"),
                     F.try_divide(F.col(f"_c{i}"), F.sqrt(F.col(f"_vx{i}") * F.col(f"_vy{i}"))).alias("r"))
            for i, f in enumerate(features)]
    out = agg.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    return _flag(out, threshold)


def spearman_target(df: DataFrame, target: str, features=None, threshold: float = 0.0,
                    id_col: str | None = None) -> DataFrame:
    """Spearman rho with average ranks, pairwise-complete (E2) and the keep flag.

    Features are reshaped long; ranks of the feature and of the target are computed
    per feature over that feature's complete pairs (skew-safe ``average_ranks``).
    """
    features = features or numeric_columns(df, exclude=(target,))
    ids = [id_col] if id_col else []
    base = df.select(*[as_col(i) for i in ids], *[as_col(f) for f in features],
                     as_col(target).cast("double").alias("_y"))
    long = to_long(base, ids + ["_y"], features).where(F.col("value").isNotNull() & F.col("_y").isNotNull())
    # both rank tables come from the long table directly (not one from the other),
    # and are joined back once each on (feature, value) / (feature, y)
    rx = rank_table(long, "value", ["feature"], out="_rx", value_out="_vx")
    ry = rank_table(long, "_y", ["feature"], out="_ry", value_out="_vy")
    k = long.select("feature", (F.col("value") + F.lit(0.0)).alias("_vx"), (F.col("_y") + F.lit(0.0)).alias("_vy"))
    ranked = k.join(rx, ["feature", "_vx"]).join(ry, ["feature", "_vy"])
    out = ranked.groupBy("feature").agg(
        F.try_divide(F.covar_pop("_rx", "_ry"), F.sqrt(F.var_pop("_rx") * F.var_pop("_ry"))).alias("r"))
    return _flag(out, threshold)


def _flag(scores: DataFrame, threshold: float) -> DataFrame:
    keep = F.col("r").isNull() | (F.abs("r") >= F.lit(float(threshold)))
    return scores.select("feature", "r", F.abs("r").alias("abs_r"), keep.alias("keep"))


def removal_report(scores: DataFrame, current_cols, score_col: str = "r", threshold: float = 0.0,
                   signed: bool = False) -> DataFrame:
    """(feature, score, status) with status removed / absent / kept.

    ``signed`` compares the raw score (importance, E6); otherwise its absolute value.
    """
    s = F.col(score_col) if signed else F.abs(score_col)
    below = F.col(score_col).isNotNull() & (s < F.lit(float(threshold)))
    present = F.col("feature").isin(list(current_cols))
    status = F.when(~below, F.lit("kept")).when(present, F.lit("removed")).otherwise(F.lit("absent"))
    return scores.select("feature", F.col(score_col).alias("score"), status.alias("status"))


def remove_features(df: DataFrame, report: DataFrame) -> DataFrame:
    """Drop the features the report marks removed (E4-E6).  Collects names only."""
    names = [r["feature"] for r in report.where(F.col("status") == "removed").select("feature").collect()]
    return df.drop(*names)


def rethreshold(importance: DataFrame, threshold: float, col: str = "importance") -> DataFrame:
    """Re-apply a threshold to a stored importance table."""
    return importance.withColumn("keep", F.col(col) >= F.lit(float(threshold)))


def rank_features(scores: DataFrame, col: str = "importance", descending: bool = True) -> DataFrame:
    """Sort features by a score (E11); the table is schema-sized."""
    return scores.orderBy(F.col(col).desc() if descending else F.col(col).asc(), "feature")
