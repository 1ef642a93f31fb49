"""Plans that hold at size: what moves between stages, and how often it is worked out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators.metrics import auc
from probity.plans import ordering


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _by_hand(rows):
    pos, neg = [p for _, p, y in rows if y == 1 and p is not None], [p for _, p, y in rows if y == 0 and p is not None]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("crowded", [1 << 17, 4])
def test_auc_sums_up_in_its_buckets(spark, monkeypatch, crowded):
    """no join of rows with totals, scores drawn once, the same value whether or not buckets are cut."""
    monkeypatch.setattr(ordering, "CROWDED", crowded)
    monkeypatch.setattr(ordering, "PART", crowded // 2)
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 0 if crowded == 4 else 1 << 21)
    rng = np.random.default_rng(3)
    rows = [(g, None if rng.random() < 0.05 else float(rng.choice([0.5, -1.0, 0.0, 1e-9, float(rng.random())])), int(rng.integers(2)))
            for g in ["a", None] for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    found = {r["g"]: r for r in auc(df, by="g").collect()}
    assert set(found) == {"a", None}
    for g, r in found.items():
        mine = [x for x in rows if x[0] == g]
        assert r["auc"] == pytest.approx(_by_hand(mine), abs=1e-12)
        assert r["n_pos"] + r["n_neg"] == sum(p is not None for _, p, _ in mine)
    drawn = df.withColumn("p", F.length(F.md5(F.col("p").cast("string"))) + F.col("p"))
    if crowded != 4:
        assert "Join Inner" not in _plan(auc(drawn, by="g"))      # only the broadcast cuts
        assert not [x for x in _plan(auc(drawn, by="g")).splitlines() if "Filter" in x and "md5" in x]


def _joins(node):
    found = [node] if node.nodeName() == "Join" else []
    return found + [x for i in range(node.children().size()) for x in _joins(node.children().apply(i))]


def test_shapley_draws_travel_without_their_rows(spark):
    """the background sees index and draw number only; equal and null ids add up as before."""
    from probity.operators import explain
    from probity.operators.scoring import Scorer
    scorer = Scorer.from_columns(p=F.col("f1") * F.lit(0.1) + F.col("f2") * F.col("f1") * F.lit(0.01))
    bg = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)], "id long, f1 double, f2 double")
    rows = [("a", 1.0, 2.0), ("a", 3.0, 5.0), (None, 4.0, 1.0), ("b", 2.0, 2.0)]

    def phi(some):
        df = spark.createDataFrame(some, "id string, f1 double, f2 double")
        return explain.sampled_shap(df, scorer, ["f1", "f2"], bg, n_samples=8, background_id="id")

    whole = phi(rows)
    joins = [j for j in _joins(whole._jdf.queryExecution().optimizedPlan()) if "_zi" in str(j.condition())]
    assert len(joins) == 1
    sides = [joins[0].left().output().mkString(","), joins[0].right().output().mkString(",")]
    assert not [x for x in sides if "_id#" in x or "f1#" in x or "_order" in x]
    found = {(r["id"], r["feature"]): r["phi"] for r in whole.collect()}
    assert len(found) == 6
    parts = {}
    for r in rows:
        for x in phi([r]).collect():
            parts[x["id"], x["feature"]] = parts.get((x["id"], x["feature"]), 0.0) + x["phi"]
    assert found == pytest.approx(parts)


def test_quantile_draws_are_joined_once(spark):
    """one lookup for both order statistics, with numpy's quantiles as result."""
    from probity.functions.hashing import uniforms
    from probity.operators import robust
    t = spark.createDataFrame([(f"r{i}", float((i * 37) % 23) if i % 11 else None) for i in range(60)], "id string, f2 double")
    runs = robust.explode_runs(robust.with_percentile(t, "f2", "_pct"), (0.0, 0.3), 2)
    out = robust.quantile_noise(runs, t, "f2", "_pct", "id", seed=0)
    assert sum("_k0" in str(j.condition()) or "_k1" in str(j.condition()) for j in _joins(out._jdf.queryExecution().optimizedPlan())) == 1
    known = [r["f2"] for r in t.collect() if r["f2"] is not None]
    drawn = {(r["id"], r["run"]): r for r in runs.withColumn("u", uniforms("id", "run", salt="qn:0:f2", n=1)[0]).collect()}
    for r in out.collect():
        d = drawn[r["id"], r["run"]]
        if d["_pct"] is None:      # least and greatest skip nulls: such a row is drawn at the lower end, as before
            continue
        q = min(max(d["_pct"] + (d["u"] * 2 - 1) * d["size"], 0.0), 1.0)
        assert r["f2"] == pytest.approx(np.quantile(known, q))


def _jobs(spark, run) -> int:
    """Spark jobs that a call starts."""
    group = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_by_hash_reads_its_rows_twice(spark):
    """one pass for the counts, one for the rows; equal draws by the tie-breaker."""
    from probity.functions.hashing import hash01
    df = spark.createDataFrame([(f"k{i}", i) for i in range(500)], "id string, v long")
    draw = hash01("id", salt="s")
    for n in (0, 1, 77, 500, 900):
        out = ordering.first_by_hash(df, draw, "id", n)
        plan = out._jdf.queryExecution().optimizedPlan()
        assert not _joins(plan) and plan.collectLeaves().size() == 1
        wanted = [r["id"] for r in df.withColumn("h", draw).orderBy("h", "id").limit(n).collect()]
        assert sorted(r["id"] for r in out.collect()) == sorted(wanted)


def test_learning_curve_scores_all_fits_in_one_pass(spark):
    """besides the fits there are a few jobs, not three for every fit; the scores are those of each fit alone."""
    from probity.functions.hashing import hash01
    from probity.operators import overfit, train
    rows = [(f"r{i}", float(i % 17), float(i % 5), int((i * 7) % 17 > 8)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, a double, b double, y int").withColumn("label", F.col("y").cast("double")).cache()
    est = train.make_pipeline("tree", "classification", ["a", "b"])
    seen = df.withColumn("k", F.floor(hash01("id", salt="fold:0") * 3)).withColumn("u", hash01("id", salt="lc:0")).cache()
    tr = seen.where((F.col("k") != 0) & (F.col("u") < 0.5))
    fit_jobs = _jobs(spark, lambda: est.fit(tr))
    curve = []
    jobs = _jobs(spark, lambda: curve.append(overfit.learning_curve(df, est, sizes=(0.5, 1.0), folds=3)))
    assert jobs <= 6 * (fit_jobs + 1) + 6
    row = {r["size"]: r for r in curve[0].collect()}[0.5]
    n, cv = [], []
    for k in range(3):
        part = seen.where((F.col("k") != k) & (F.col("u") < 0.5))
        model = est.fit(part)
        n.append(part.count())
        te = model.transform(seen.where(F.col("k") == k))
        cv.append(te.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])
    assert row["n_train"] == pytest.approx(np.mean(n)) and row["cv_mean"] == pytest.approx(np.mean(cv))


def test_training_rows_are_spread_over_the_cores(spark):
    """A large table in one part is dealt out before the fits; a small one stays as it is."""
    from probity.operators import train
    df = spark.range(0, 100, 1, 1).select(F.col("id").cast("double").alias("a"))
    assert train.spread_rows(df, per_part=10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert train.spread_rows(df, per_part=100).rdd.getNumPartitions() == 1
    assert sorted(r["a"] for r in train.spread_rows(df, per_part=10).collect()) == [float(i) for i in range(100)]
