"""Dense codes without the driver, quantile noise at the clipped ends, features of "all"."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from probity.operators import clean, robust
from probity.operators.scoring import Scorer


def test_codes_of_many_labels_are_their_sorted_positions(spark):
    labels = [f"k{(i * 7919) % 5000}" for i in range(5000)] + ["k1"] * 3000 + ["", "é", "Z"]
    df = spark.createDataFrame(list(enumerate([*labels, None])), "id long, s string").repartition(7)
    got = {r["id"]: r["c"] for r in clean.label_encode(df.withColumn("c", F.lit(0)).drop("c").withColumnRenamed("s", "c"), ["c"]).collect()}
    place = {v: i for i, v in enumerate(sorted(set(labels), key=lambda x: x.encode()))}
    assert got == {i: place[v] for i, v in enumerate(labels)} | {len(labels): None}
    assert clean.label_encode(df.limit(0), ["s"], "_code").columns == ["id", "s", "s_code"]


def test_quantile_noise_equals_numpy_also_where_clipped(spark):
    values = [0.0] * 30 + [float(i) for i in range(20)] + [50.0] * 30
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    base = robust.with_percentile(df, "x", "_pct")
    pct = {r["id"]: r["_pct"] for r in base.collect()}
    runs = robust.explode_runs(base, [0.0, 0.5, 1.5], 3)
    seen = set()
    for r in robust.quantile_noise(runs, df, "x", "_pct").collect():
        u = (int(hashlib.md5(f"qn:0:x#0:{r['id']}:{r['run']}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32
        q = min(max(pct[r["id"]] + (2 * u - 1) * r["size"], 0.0), 1.0)
        seen.add(q if q in (0.0, 1.0) else 0.5)
        assert math.isclose(r["x"], float(np.quantile(values, q)), abs_tol=1e-9)
    assert seen == {0.0, 0.5, 1.0}


def test_all_features_leave_out_split_and_scores(spark):
    rows = [(i, float(i % 10), i % 2, "test", 0.9, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y int, split string, p double, yh int")
    scorer = Scorer.from_columns(p=F.col("x") / F.lit(10.0))
    every = robust.robustness_runs(df, scorer, sizes=[0.0, 0.2], iterations=2).collect()
    named = robust.robustness_runs(df, scorer, ["x"], sizes=[0.0, 0.2], iterations=2).collect()
    assert sorted(every) == sorted(named) and len(every) == 4
