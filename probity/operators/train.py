"""Model training, leaderboard and registry.

Every model is an MLlib Pipeline (VectorAssembler + estimator) fit on the cached
training split; fits run on the executors, the driver only loops over model names.
The leaderboard scores all models in one table with a ``model`` column and groups
by it, so adding a model adds rows, not jobs.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.util import as_col
from probity.operators import binned
from probity.operators.metrics import auc, auc_ovr, binary_metrics, join_groups, macro_metrics, regression_metrics
from probity.operators.scoring import Scorer
from probity.session import cut_lineage

FEATURES_COL = "_features"
ROWS_PER_PART = 50_000       # training rows below which a part is not split

# Default settings of the reference's model menu, mapped to MLlib parameters.
CLASSIFIERS = ("logistic", "tree", "forest", "gbm", "lightgbm", "xgboost", "mlp")
REGRESSORS = ("linear", "tree", "forest", "gbm", "lightgbm", "xgboost")
# Override names of the model menu and the MLlib parameters they set.
PARAM_NAMES = {"max_depth": "maxDepth", "learning_rate": "stepSize", "max_iter": "maxIter", "subsample": "subsamplingRate",
               "colsample_bytree": "featureSubsetStrategy", "fit_intercept": "fitIntercept", "hidden_layer_sizes": "hidden",
               "random_state": "seed"}


def class_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """Balanced weights n / (K · n_c) joined onto every row.

    The class table has K rows, so it is broadcast by construction.
    """
    counts = df.groupBy(as_col(y).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select("_cls", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), as_col(y) == F.col("_cls"), "left").drop("_cls")


def parse_layers(text) -> list[int]:
    """'100,50' → [100, 50] (F14); lists pass through."""
    if isinstance(text, (list, tuple)):
        return [int(x) for x in text]
    return [int(x) for x in str(text).replace(" ", "").split(",") if x]


def map_params(name: str, params: dict | None) -> dict:
    """Overrides under their scikit-learn style names as MLlib parameters; MLlib names pass through.

    ``min_samples_split`` becomes half of it per leaf, the nearest rule MLlib has;
    ``class_weight`` and ``C`` stay, as they need the training rows.
    """
    out = {}
    for key, value in (params or {}).items():
        if key == "min_samples_split":
            out["minInstancesPerNode"] = max(1, -(-int(value) // 2))
        elif key == "n_estimators":
            out["numTrees" if name == "forest" else "maxIter"] = int(value)
        else:
            out[PARAM_NAMES.get(key, key)] = str(value) if key == "colsample_bytree" else value
    return out


def make_estimator(name: str, task: str, n_features: int, n_classes: int = 2, params: dict | None = None,
                   weight_col: str | None = None, n_rows: int | None = None):
    """Estimator for a model name with the reference defaults (F1-F12), params overridden.

    Logistic regression minimises |w|^2 / 2 + C * sum of row losses; MLlib takes the mean
    loss, so ``C`` needs the number of training rows unless ``regParam`` is given.
    """
    p = map_params(name, params)
    p.pop("class_weight", None)
    fc, lc = FEATURES_COL, "label"
    if task == "classification":
        if name == "logistic":
            c = p.pop("C", 1.0)
            if "regParam" not in p and not n_rows:
                raise ValueError("logistic regression needs n_rows (for C) or regParam")
            est = LogisticRegression(featuresCol=fc, labelCol=lc, maxIter=p.pop("maxIter", 1000),
                                     regParam=p.pop("regParam") if "regParam" in p else 1.0 / (c * n_rows),
                                     elasticNetParam=0.0, standardization=False, family="auto")
            if weight_col:
                est.setWeightCol(weight_col)
        elif name == "tree":
            est = DecisionTreeClassifier(featuresCol=fc, labelCol=lc, impurity="gini", maxDepth=5,
                                         minInstancesPerNode=p.pop("minInstancesPerNode", 10), seed=0)
        elif name == "forest":
            est = RandomForestClassifier(featuresCol=fc, labelCol=lc, numTrees=100, maxDepth=5, seed=0)
        elif name in ("gbm", "lightgbm", "xgboost"):
            kw = dict(maxIter=100, stepSize=0.1, maxDepth=5 if name != "xgboost" else 6, seed=0)
            if name == "lightgbm":
                kw.update(maxBins=255)
            if name == "xgboost":
                kw.update(subsamplingRate=0.8, featureSubsetStrategy="0.8")
            gbt = GBTClassifier(featuresCol=fc, labelCol=lc, **kw)
            if n_classes > 2:  # overrides are the inner model's
                gbt, p = gbt.copy({gbt.getParam(k): v for k, v in p.items()}), {}
            est = gbt if n_classes <= 2 else OneVsRest(classifier=gbt, featuresCol=fc, labelCol=lc)
        elif name == "mlp":
            layers = [n_features] + parse_layers(p.pop("hidden", [100])) + [max(n_classes, 2)]
            est = MultilayerPerceptronClassifier(featuresCol=fc, labelCol=lc, layers=layers, maxIter=200, seed=0)
        else:
            raise ValueError(f"unknown classifier {name!r}")
    else:
        if name == "linear":
            est = LinearRegression(featuresCol=fc, labelCol=lc)
        elif name == "tree":
            est = DecisionTreeRegressor(featuresCol=fc, labelCol=lc, maxDepth=5,
                                        minInstancesPerNode=p.pop("minInstancesPerNode", 10), seed=0)
        elif name == "forest":
            est = RandomForestRegressor(featuresCol=fc, labelCol=lc, numTrees=100, maxDepth=5, seed=0)
        elif name in ("gbm", "lightgbm", "xgboost"):
            kw = dict(maxIter=100, stepSize=0.1, maxDepth=5 if name != "xgboost" else 6, seed=0)
            if name == "lightgbm":
                kw.update(maxBins=255)
            if name == "xgboost":
                kw.update(subsamplingRate=0.8, featureSubsetStrategy="0.8")
            est = GBTRegressor(featuresCol=fc, labelCol=lc, **kw)
        else:
            raise ValueError(f"unknown regressor {name!r}")
    if p:
        est = est.copy({est.getParam(k): v for k, v in p.items()})
    return est


def make_pipeline(name: str, task: str, features, n_classes: int = 2, params: dict | None = None,
                  weight_col: str | None = None, n_rows: int | None = None) -> Pipeline:
    # a null or NaN feature raises: impute or drop rows first (clean.*), never silently here
    asm = VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL, handleInvalid="error")
    return Pipeline(stages=[asm, make_estimator(name, task, len(features), n_classes, params, weight_col, n_rows)])


def _fit_one(data: DataFrame, name: str, task: str, features, n_classes: int, params: dict | None, cells: dict | None = None) -> PipelineModel:
    """Fit on rows with a ``label``; logistic regression gets its C and balanced weights.

    Trees are fitted on counted cells of a large table (``binned``), which ``cells`` keeps for further fits.
    """
    if task != "classification" or name != "logistic":
        return binned.fit(make_pipeline(name, task, features, n_classes, params), data, cells)
    weight = None
    if (params or {}).get("class_weight", "balanced") == "balanced":
        weight = "_weight"
        data = class_weights(data, "label", weight)
    return make_pipeline(name, task, features, n_classes, params, weight, data.count()).fit(data)


def fit(df: DataFrame, name: str, task: str, features, y: str = "y", n_classes: int = 2,
        params: dict | None = None) -> PipelineModel:
    """Fit one model on ``df``."""
    data = df.withColumn("label", as_col(y).cast("double"))
    return _fit_one(data, name, task, features, n_classes, params)


def spread_rows(df: DataFrame, per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df`` in as many parts as the cluster has cores, if it has fewer and more than ``per_part`` rows in one."""
    want, have = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if have >= want or (parts := min(want, -(-df.count() // per_part))) <= have:
        return df
    return df.repartition(parts)


def train_models(train: DataFrame, test: DataFrame, names, task: str, features, y: str = "y",
                 n_classes: int = 2, params: dict | None = None, id_col: str = "id"):
    """Fit every named model on ``train`` and score ``test`` into one table.

    Returns (models dict, scored DataFrame with a ``model`` column).
    """
    params = params or {}
    # what the fits read, in enough parts for the cluster: every pass of a fit runs over these
    named = {v for p in params.values() for v in (p or {}).values() if isinstance(v, str)}      # a weight column, say
    train = spread_rows(train.withColumn("label", as_col(y).cast("double")).select(
        *[as_col(c) for c in dict.fromkeys([*features, "label"])], *[as_col(c) for c in train.columns if c in named - {*features, "label"}])).persist()
    models, cells = {}, {}
    for name in names:
        models[name] = _fit_one(train, name, task, features, n_classes, params.get(name), cells)
    binned.free(cells)
    train.unpersist()
    if not models:
        return models, None
    outputs = ["yh"] + (["p"] if task == "classification" and n_classes <= 2 else []) + (["probs"] if task == "classification" else [])
    # all models score a row side by side, so the test rows are read once
    given = test.columns
    wide = test.select(*[as_col(c) for c in given], *[as_col(c).alias(k) for c, k in ((id_col, "_id"), (y, "_y"))])
    for i, model in enumerate(models.values()):
        wide = Scorer(model=model, task=task, n_classes=n_classes).score(wide).withColumnsRenamed({c: f"_{c}{i}" for c in outputs})
    each = F.array(*[F.struct(F.lit(name).alias("model"), *[F.col(f"_{c}{i}").alias(c) for c in outputs]) for i, name in enumerate(models)])
    scored = wide.select(F.col("_id").alias(id_col), F.col("_y").alias(y), F.explode(each).alias("_s"))
    return models, scored.select(as_col(id_col), as_col(y), *[F.col(f"_s.{c}").alias(c) for c in outputs], F.col("_s.model").alias("model"))


def leaderboard(scored: DataFrame, task: str, n_classes: int = 2, y: str = "y", n_features: int = 0) -> DataFrame:
    """One row per model with the reference's metric columns (F16)."""
    if task == "regression":
        return regression_metrics(scored, y, "yh", by="model", n_features=n_features).select(
            "model", F.col("mse").alias("MSE"), F.col("rmse").alias("RMSE"), F.col("mae").alias("MAE"),
            F.col("r2").alias("R2"))
    if n_classes <= 2:
        scored = cut_lineage(scored.select("model", as_col(y), "yh", "p"))      # scored once, read for counts and for AUC
        m = binary_metrics(scored, y, "yh", None, by="model")
        a = auc(scored, y, "p", by="model").select("model", F.col("auc").alias("AUC"))
        return join_groups(m, a, "model").select("model", F.col("accuracy").alias("Accuracy"),
                                         F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
                                         F.col("f1").alias("F1"), "AUC")
    m = macro_metrics(scored, y, "yh", by="model")
    a = auc_ovr(scored, y, "probs", by="model").groupBy("model").agg(F.avg("auc").alias("AUC"))
    return join_groups(m, a, "model").select("model", F.col("accuracy").alias("Accuracy"),
                                     F.col("precision_macro").alias("Precision"),
                                     F.col("recall_macro").alias("Recall"), F.col("f1_macro").alias("F1"), "AUC")


def register_models(board: DataFrame, names) -> DataFrame:
    """Keep the leaderboard rows of the chosen models (semi-join)."""
    chosen = board.sparkSession.createDataFrame([(n,) for n in names], "model string")
    return board.join(F.broadcast(chosen), "model", "left_semi")


def save_model(model: PipelineModel, path: str, name: str, metrics: dict | None = None) -> dict:
    """Save a fitted pipeline with a metadata file (name, time, metrics)."""
    model.write().overwrite().save(f"{path}/model")
    meta = {"name": name, "saved_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "metrics": metrics or {}}
    from pyspark.sql import SparkSession
    SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
