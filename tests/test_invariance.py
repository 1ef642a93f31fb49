"""SURVEY §5 (4): results do not depend on the partition count."""

import numpy as np
from pyspark.sql import functions as F

from probity.operators import explain, metrics, reliability, resilience, robust
from probity.operators.scoring import Scorer


def _frame(spark):
    rng = np.random.default_rng(8)
    n = 240
    rows = [(f"r{i}", float(np.round(a, 1)), float(b), int(c), float(np.round(d, 2)))
            for i, (a, b, c, d) in enumerate(zip(rng.normal(size=n), rng.uniform(size=n), rng.integers(0, 2, n),
                                                 rng.uniform(size=n)))]
    return spark.createDataFrame(rows, "id string, x1 double, x2 double, y int, p double")


def _run_all(df):
    sc = Scorer.from_columns(p=F.lit(0.5) + F.col("x1") / F.lit(10.0))
    res = resilience.residual_column(df)
    both = df.withColumn("side", F.when(F.col("x2") < 0.5, "expected").otherwise("actual"))
    out = {
        "auc": metrics.auc(df).collect(),
        "roc": sorted(metrics.roc_curve(df).collect()),
        "psi": resilience.psi(both, ["x1", "x2"]).orderBy("feature").collect(),
        "worst": sorted(r["id"] for r in resilience.worst_samples(res, 0.2).collect()),
        "perm": sorted(explain.permutation_importance(df, sc, ["x1", "x2"], "ACC", repeats=2).collect()),
        "robust": sorted(robust.robustness_runs(df.select("id", "x1", "x2", "y"), sc, ["x1", "x2"], metric="ACC",
                                                sizes=(0.1,), iterations=2).collect()),
        "pv": sorted(reliability.conformal_pvalues(
            df.select(F.col("p").alias("strangeness")),
            df.select("id", F.col("x2").alias("strangeness"))).collect()),
    }
    return out


def test_partition_count_invariance(spark):
    df = _frame(spark)
    a = _run_all(df.repartition(1))
    b = _run_all(df.repartition(11))
    for k in a:
        assert a[k] == b[k], k
