"""LIME's draws in runs are the md5 draws of ``uniforms``."""

import hashlib

import pytest
from pyspark.sql import functions as F

from probity.functions import hashing
from probity.operators import explain
from probity.operators.scoring import Scorer


@pytest.mark.parametrize("ids", [["a", "", None, "é" * 30], [f"{'y' * n}" for n in range(140)]])
def test_runs_of_draws_are_the_md5_draws(ids):
    got = hashing.uniforms_of_runs(ids, 12, "lime:3", 6)
    for i, x in enumerate(ids):
        for s in range(12):
            key = str(s) if x is None else f"{x}:{s}"
            text = [hashlib.md5(f"lime:3#{j}:{key}".encode()).hexdigest() for j in range(2)]
            want = [(int(text[d // 4][8 * (d % 4):8 * (d % 4) + 8], 16) + 0.5) / 2 ** 32 for d in range(6)]
            assert got[:, i, s].tolist() == want


def test_lime_samples_come_from_one_python_stage(spark):
    """Samples are drawn a row at a time, not by digits of digests a sample."""
    df = spark.createDataFrame([(i, float(i % 7), i % 5) for i in range(60)], "id long, a double, b int")
    scorer = Scorer(fn=lambda d: d.withColumn("p", F.coalesce("a", F.lit(0.0)) / 7).withColumn("probs", F.array(1 - F.col("p"), "p")).withColumn("yh", F.lit(1)),
                    task="classification")
    out = explain.lime(df.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), scorer, ["a", "b"], df, n_samples=30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "md5(" not in plan and "MapInArrow" in plan
    rows = out.collect()
    assert len(rows) == 120 and all(r["weight"] is not None for r in rows)
