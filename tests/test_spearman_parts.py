"""Spearman matrix: rows brought together by id once, in parts that grow with the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from probity.operators import profile


def test_spearman_brings_rows_together_once_in_parts(spark, monkeypatch):
    """The parts grow with the rows, and only one shuffle is by id (it was a row a column and id before)."""
    monkeypatch.setattr(profile, "ROWS_A_TASK", 10)
    monkeypatch.setattr(profile, "RANKS_BROADCAST", 50)      # a is joined by value, b by broadcast
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(400) // 2 * 2, "a": np.repeat(rng.permutation(200) / 7, 2), "b": np.repeat(rng.integers(-2, 3, 200) / 2.0, 2),
                        "c": np.repeat(rng.random(200), 2)})       # every row comes twice
    pdf.loc[pdf["id"] % 10 == 0, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    out = profile.spearman_matrix(df, ["a", "b", "c"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_id" in plan and plan.count("hashpartitioning(_id") == 1 and ", 40), REPARTITION_BY_NUM" in plan
    ranks = pdf[["a", "b", "c"]].rank()[::2]
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in out.collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert np.isclose(got[a, b], ranks[a].corr(ranks[b]))


def test_spearman_takes_the_largest_value_of_an_id(spark):
    rows = [(i, float(v), float(w)) for i in range(20) for v, w in ((i, -i), (i - 30, -i - 30))]
    got = profile.spearman_matrix(spark.createDataFrame(rows, "id long, a double, b double").repartition(6), ["a", "b"]).first()
    assert np.isclose(got["r"], -1.0)
