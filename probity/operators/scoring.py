"""Scoring (H4): one interface for a fitted MLlib model or a column expression.

Diagnostics that re-score perturbed rows (permutation importance, noise
sensitivity, robustness, partial dependence, Shapley sampling, LIME) take a
``Scorer``.  A scorer adds ``p`` (positive-class probability, binary), ``probs``
(array of class probabilities) and ``yh`` (label or regression value) to any
DataFrame that has the feature columns.  With an MLlib ``PipelineModel`` the work
stays in the JVM (``transform``); an expression scorer is plain Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer:
    """Wraps ``model`` (PipelineModel / Transformer) or ``fn`` (DataFrame → DataFrame)."""

    def __init__(self, model=None, fn: Callable[[DataFrame], DataFrame] | None = None,
                 task: str = "classification", n_classes: int = 2, threshold: float = 0.5):
        if (model is None) == (fn is None):
            raise ValueError("give exactly one of model or fn")
        self.model, self.fn = model, fn
        self.task, self.n_classes, self.threshold = task, n_classes, threshold

    @classmethod
    def from_columns(cls, p: Column | None = None, yh: Column | None = None, task: str = "classification",
                     threshold: float = 0.5) -> Scorer:
        """Scorer from column expressions over the features (binary p, or regression yh)."""
        if task == "regression":
            return cls(fn=lambda df: df.withColumn("yh", yh), task=task)

        def fn(df):
            out = df.withColumn("p", p)
            out = out.withColumn("probs", F.array(F.lit(1.0) - F.col("p"), F.col("p")))
            return out.withColumn("yh", F.when(F.col("p") >= F.lit(threshold), 1).otherwise(0))
        return cls(fn=fn, task=task, threshold=threshold)

    def score(self, df: DataFrame) -> DataFrame:
        drop = [c for c in ("p", "probs", "yh") if c in df.columns]
        base = df.drop(*drop)
        if self.fn is not None:
            return self.fn(base)
        out = self.model.transform(base)
        if self.task == "regression":
            out = out.withColumn("yh", F.col("prediction").cast("double"))
        else:
            if "probability" in out.columns:
                out = out.withColumn("probs", vector_to_array(F.col("probability")))
            else:  # one-vs-rest boosted trees: each margin through its sigmoid (MLlib's 2x margin), then normalised
                raw = vector_to_array(F.col("rawPrediction"))
                out = out.withColumn("probs", F.transform(raw, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * x)))) \
                         .withColumn("probs", F.transform("probs", lambda x: x / F.aggregate(
                             F.col("probs"), F.lit(0.0), lambda a, b: a + b)))
            out = out.withColumn("yh", F.col("prediction").cast("int"))
            if self.n_classes <= 2:
                out = out.withColumn("p", F.element_at("probs", 2))
                if self.threshold != 0.5:
                    out = out.withColumn("yh", (F.col("p") >= F.lit(self.threshold)).cast("int"))
        helper = [c for c in ("features", "rawPrediction", "probability", "prediction", "_features")
                  if c in out.columns and c not in df.columns]
        helper += [c for c in out.columns if c.startswith("_bin") and c not in df.columns]      # of binned.bucketizer
        return out.drop(*helper)


def score(df: DataFrame, scorer: Scorer | PipelineModel) -> DataFrame:
    """Score ``df`` with a Scorer or a fitted PipelineModel (H4)."""
    if isinstance(scorer, Scorer):
        return scorer.score(df)
    return Scorer(model=scorer).score(df)


def eval_kwargs(scorer: Scorer) -> dict:
    """Arguments for ``metrics.evaluate`` that match what the scorer produces."""
    if scorer.task == "regression":
        return {"yh": "yh"}
    if scorer.n_classes > 2:
        return {"probs": "probs", "n_classes": scorer.n_classes}
    return {"p": "p"}
