"""Overfitting tests.

Train and test scores come from one scored table grouped by split; the learning
curve is a short driver loop of distributed fits (6 sizes × 3 folds) whose inputs
are hash-nested subsets, so every fit sees a deterministic sample.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.hashing import gaussians, hash01
from probity.functions.util import as_col, quote
from probity.operators import binned
from probity.operators.metrics import evaluate
from probity.operators.scoring import Scorer, eval_kwargs
from probity.plans.reshape import spread_for_fanout
from probity.session import cut_lineage

CLASSIFICATION_SET = (("Accuracy", "ACC", True), ("AUC", "AUC", True), ("F1", "F1", True))
REGRESSION_SET = (("R2", "R2", True), ("MAE", "MAE", False), ("MSE", "MSE", False))


def train_test_gap(scored: DataFrame, task: str = "classification", split: str = "split", train="train",
                   test="test", threshold: float = 0.05, by=(), **eval_kw) -> DataFrame:
    """Train and test score per metric, gap signed by direction, flag gap > 0.05 (O1).

    ``by`` adds grouping columns (a tree leaf, a feature bin) for the gap by
    segment (V9).
    """
    by = [by] if isinstance(by, str) else list(by)
    metrics = CLASSIFICATION_SET if task == "classification" else REGRESSION_SET
    parts = []
    for label, key, higher in metrics:
        m = evaluate(scored.where(as_col(split).isin(train, test)), key, by=[*by, split], **eval_kw)
        parts.append(m.groupBy(*by).agg(
            F.max(F.when(F.col(split) == train, F.col("value"))).alias("train"),
            F.max(F.when(F.col(split) == test, F.col("value"))).alias("test"))
            .withColumn("metric", F.lit(label)).withColumn("higher_is_better", F.lit(higher)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    gap = F.when(F.col("higher_is_better"), F.col("train") - F.col("test")).otherwise(F.col("test") - F.col("train"))
    return out.select(*by, "metric", "train", "test", gap.alias("gap"), (gap > F.lit(threshold)).alias("overfit"))


def learning_curve(df: DataFrame, estimator, task: str = "classification", y: str = "y", id_col: str = "id",
                   sizes=(0.1, 0.28, 0.46, 0.64, 0.82, 1.0), folds: int = 3, seed: int = 0,
                   featurize=None) -> DataFrame:
    """Train and cross-validated score at 6 training sizes, 3 folds (O2).

    ``estimator`` is an unfitted MLlib Pipeline/estimator; ``featurize`` (optional)
    maps the DataFrame to what the estimator expects.  Scores: accuracy or R².
    Returns (size, n_train, train_mean, train_std, cv_mean, cv_std), std over folds
    with ddof 0 (numpy).
    """
    metric = "ACC" if task == "classification" else "R2"
    base = df.withColumn("_fold", F.least(F.floor(hash01(id_col, salt=f"fold:{seed}") * F.lit(folds)).cast("int"),
                                          F.lit(folds - 1))) \
             .withColumn("_u", hash01(id_col, salt=f"lc:{seed}"))
    parts = None if featurize or task != "classification" else binned.parts_of(estimator)
    if parts is not None:       # read by every fit: what the pipeline looks at, and no more
        base = base.select(*[as_col(c) for c in dict.fromkeys([*parts[0].getInputCols(), parts[1].getLabelCol(), y])], "_fold", "_u").persist()
    else:
        base = cut_lineage(featurize(base) if featurize else base)
    fits = [(float(size), k) for size in sizes for k in range(folds)]
    inside = [(F.col("_fold") != k) & (F.col("_u") < F.lit(size)) for size, k in fits]
    # a model of cells scores counted cells; all others are scored side by side in one pass, training and held-out rows together
    wide, out, found, by_rows = base.withColumn("_y", as_col(y)), "yh" if task == "regression" else "p", {}, []
    for i, (_, k) in enumerate(fits):
        model = binned.fit(estimator, base.where(inside[i])) if parts is not None else estimator.fit(base.where(inside[i]))
        if parts is not None and binned.takes_bins(model):
            found |= {(i, key): value for key, value in _accuracy_of_cells(base, model, inside[i], F.col("_fold") == k, y).items()}
            continue
        by_rows.append(i)
        wide = Scorer(model=model, task=task).score(wide).withColumnRenamed(out, f"_out{i}")
    if by_rows:
        cells = F.array(*[F.struct(F.lit(i).alias("fit"), inside[i].alias("inside"), (F.col("_fold") == fits[i][1]).alias("held"),
                                   F.col(f"_out{i}").cast("double").alias("out")) for i in by_rows])
        scored = wide.select("_y", F.explode(cells).alias("_c")).select("_y", "_c.*").where(F.col("inside") | F.col("held"))
        found |= {(r["fit"], r["inside"]): r["value"] for r in evaluate(scored, metric, by=["fit", "inside"], y="_y", **{out: "out"}).collect()}  # two rows a fit
    sizes_of = base.agg(*[F.count_if(c) for c in inside]).first()
    base.unpersist()
    rows = [(size, k, sizes_of[i], found.get((i, True)), found.get((i, False))) for i, (size, k) in enumerate(fits)]
    spark = df.sparkSession
    res = spark.createDataFrame(rows, "size double, fold int, n_train long, train double, cv double")
    return res.groupBy("size").agg(
        F.avg("n_train").alias("n_train"), F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("cv").alias("cv_mean"), F.stddev_pop("cv").alias("cv_std")).orderBy("size")


def _accuracy_of_cells(base: DataFrame, model, inside, held, y: str) -> dict:
    """Accuracy of training (True) and held-out rows (False): rows of equal bins and label are counted, then scored once."""
    counted = model.stages[0].transform(base.where(inside | held)).groupBy(*model.stages[0].getOutputCols(), as_col(y).alias("_y"), inside.alias("_in")) \
                   .agg(F.count(F.lit(1)).alias("_n"))
    right = F.col("_y") == F.when(F.col("p") >= F.lit(0.5), 1).otherwise(0)
    scored = Scorer(model=PipelineModel(stages=model.stages[1:])).score(counted)
    rows = scored.groupBy("_in").agg(F.try_divide(F.sum(F.when(right, F.col("_n")).otherwise(0)), F.sum(F.when(right.isNotNull(), F.col("_n")))).alias("value"))
    return {r["_in"]: r["value"] for r in rows.collect()}


def learning_curve_verdict(curve: DataFrame, gap_limit: float = 0.10, low: float = 0.60) -> DataFrame:
    """At the largest size: gap > 0.10 → high variance; CV < 0.60 → underfit; else OK (O3)."""
    last = curve.orderBy(F.col("size").desc()).limit(1)
    gap = F.abs(F.col("train_mean") - F.col("cv_mean"))
    return last.select("size", "train_mean", "cv_mean", gap.alias("gap"),
                       F.when(gap > F.lit(gap_limit), F.lit("high variance"))
                        .when(F.col("cv_mean") < F.lit(low), F.lit("underfit")).otherwise(F.lit("ok")).alias("verdict"))


def verdict_column(gap, cv_score, gap_limit: float = 0.10, low: float = 0.60):
    """The O3 rule as a column expression."""
    return (F.when(gap > F.lit(gap_limit), F.lit("high variance"))
             .when(cv_score < F.lit(low), F.lit("underfit")).otherwise(F.lit("ok")))


def noise_sensitivity(df: DataFrame, scorer: Scorer, features, y: str = "y", id_col: str = "id",
                      scale: float = 0.10, threshold: float = 0.02, seed: int = 42) -> DataFrame:
    """Score drop when Gaussian noise of σ = scale·std (n−1; 0 → 1) is added to one
    feature at a time; sensitive when the drop exceeds ``threshold`` (O4, O5).

    Features are exploded so all of them are scored in one pass.  Metric: accuracy
    (classification) or R² (regression).
    """
    features = list(features)
    metric = "ACC" if scorer.task == "classification" else "R2"
    kw = eval_kwargs(scorer)
    stds = df.agg(*[F.stddev_samp(as_col(f)).alias(f"_sd{i}") for i, f in enumerate(features)])
    base = evaluate(scorer.score(df), metric, y=y, **kw).select(F.col("value").alias("base"))
    # one draw per (row, feature), all drawn before the rows are multiplied
    zs = gaussians(id_col, salt=f"noise:{seed}", n=len(features))
    drawn = spread_for_fanout(df, id_col).select("*", *[z.alias(f"_z{i}") for i, z in enumerate(zs)])
    ex = drawn.crossJoin(F.broadcast(stds)).withColumn("_feat", F.explode(F.array(*[F.lit(f) for f in features])))
    cols = []
    for c in df.columns:
        if c in features:
            i = features.index(c)
            sd = F.coalesce(F.when(F.col(f"_sd{i}") != 0, F.col(f"_sd{i}")), F.lit(1.0))
            noisy = as_col(c) + F.col(f"_z{i}") * F.lit(scale) * sd
            cols.append(F.when(F.col("_feat") == F.lit(c), noisy).otherwise(as_col(c)).alias(c))
        else:
            cols.append(F.col(quote(c)))
    cols.append(F.col("_feat"))
    noisy = ex.select(*cols)
    sc = evaluate(scorer.score(noisy), metric, by=["_feat"], y=y, **kw)
    drop = F.col("base") - F.col("value")
    return sc.crossJoin(base).select(F.col("_feat").alias("feature"), F.lit(metric).alias("metric"),
                                     F.col("value").alias("score"), drop.alias("drop"),
                                     (drop > F.lit(threshold)).alias("sensitive"))
