"""Batched k-means against a plain Lloyd loop from the same starts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import cluster, resilience


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, size=(150, 2)) for c in ((0, 0), (4, 1), (1, 5))]) * (1.0, 100.0)
    rows = [(f"r{i}", float(a), float(b), int(rng.random() < 0.5), float(rng.random()), 7.0) for i, (a, b) in enumerate(x)]
    return x, spark.createDataFrame(rows, "id string, a double, b double, y int, p double, flat double").repartition(5)


def lloyd(x, c):
    """Passes until the centroids settle: (centroids, cost)."""
    for _ in range(cluster.MAX_PASSES):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        fresh = np.array([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        if ((fresh - c) ** 2).sum() <= cluster.TOLERANCE:
            return c, d.min(axis=1).sum()
        c = fresh
    return c, d.min(axis=1).sum()


def test_every_k_equals_plain_lloyd(points):
    x, df = points
    got = cluster.fit_clusters(df, ["a", "b"], range(2, 7), n_init=4)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    sample = sorted(df.collect(), key=lambda r: r["id"])  # fewer rows than SEEDS: all of them
    seeds = (np.array([(r["a"], r["b"]) for r in sample]) - x.mean(axis=0)) / x.std(axis=0)
    for k in range(2, 7):
        runs = [lloyd(z, cluster.plus_plus(seeds, k, np.random.default_rng([0, k, i]))) for i in range(4)]
        c, cost = min(runs, key=lambda r: r[1])
        assert np.isclose(got.costs[k], cost) and np.allclose(got.centroids[k], c)
    assert got.passes <= 60  # one pass an iteration for all 20 starts
    assert got.costs[3] < 0.2 * got.costs[2]


def test_assignment_and_worst_rows(points):
    x, df = points
    fit = cluster.fit_clusters(df, ["a", "b"], [2, 3], n_init=3)
    rows = cluster.assign_clusters(df, fit).collect()
    z = (np.array([(r["a"], r["b"]) for r in rows]) - x.mean(axis=0)) / x.std(axis=0)
    for i, k in enumerate((2, 3)):
        want = ((z[:, None] - fit.centroids[k][None]) ** 2).sum(axis=2).argmin(axis=1)
        assert [r["clusters"][i]["cluster"] for r in rows] == want.tolist() and {r["clusters"][i]["k"] for r in rows} == {k}
    scored = df.withColumn("yh", (F.col("p") >= 0.5).cast("int"))
    table = resilience.worst_cluster(scored, ["a", "b"], 3, "ACC").collect()
    worst = resilience.worst_cluster_rows(scored, ["a", "b"], 3, "ACC")
    right = worst.select(F.avg((F.col("y") == F.col("yh")).cast("double"))).first()[0]
    assert right == table[0]["value"] == min(r["value"] for r in table)
    assert {r["cluster"] for r in worst.collect()} == {table[0]["cluster"]}
    far = resilience.worst_vs_all_distance(scored, worst.drop("cluster"), ["a", "b"], "KS").collect()
    assert max(r["distance"] for r in far) > 0.5


def test_sweep_takes_the_worst_of_each_k(points):
    _, df = points
    sweep = {r["k"]: r for r in resilience.worst_cluster_sweep(df, ["a", "b"], "AUC", max_k=4, n_init=2).collect()}
    assert set(sweep) == {2, 3, 4}
    one = resilience.worst_cluster(df, ["a", "b"], 3, "AUC", n_init=2).first()
    assert (sweep[3]["cluster"], sweep[3]["value"]) == (one["cluster"], one["value"])


def test_undefined_scores_are_not_the_worst(spark):
    rows = [(i, float(i // 20 * 50), int(i % 2) if i < 20 else 1, (i * 7 % 20) / 20) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, y int, p double")
    got = resilience.worst_cluster(df, ["a"], 2, "AUC").collect()
    assert got[0]["value"] is not None and got[1]["value"] is None
    assert resilience.worst_cluster_sweep(df, ["a"], "AUC", max_k=2).first()["value"] == got[0]["value"]


def test_awkward_features(points, spark):
    _, df = points
    flat = cluster.fit_clusters(df, ["flat"], [2], n_init=1)
    assert flat.costs[2] == 0.0
    with pytest.raises(ValueError, match="null or NaN a"):
        cluster.fit_clusters(df.withColumn("a", F.when(F.col("id") != "r3", F.col("a"))), ["a", "b"], [2])
    with pytest.raises(ValueError, match="no rows"):
        cluster.fit_clusters(df.limit(0), ["a"], [2])
