"""Task set-up and deterministic splits.

Splits are thresholds on a hash of (seed, row id), so a row lands in the same split
whatever the partitioning, after a retry, or on another cluster.  ``randomSplit``
is not used: its result depends on partition layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.hashing import hash01
from probity.functions.util import as_col

TASKS = ("classification", "regression")


@dataclass(frozen=True)
class ValidationSpec:
    """Target, task, test ratio, seed and feature roles."""

    target: str
    task: str
    test_ratio: float = 0.2
    seed: int = 0
    id_col: str = "id"
    features: tuple = field(default_factory=tuple)
    categorical: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if not self.target:
            raise ValueError("target is not set")
        if self.task not in TASKS:
            raise ValueError(f"task must be one of {TASKS}, got {self.task!r}")
        if not 0.0 < float(self.test_ratio) < 1.0:
            raise ValueError("test_ratio must be in (0, 1)")

    def feature_list(self, df: DataFrame) -> list[str]:
        if self.features:
            return list(self.features)
        return [c for c in df.columns if c not in (self.target, self.id_col)]


def _names(*names):
    return F.array(*[F.lit(n) for n in names])


def train_test_split(df: DataFrame, id_col: str = "id", test_ratio: float = 0.2, seed=0,
                     out: str = "split") -> DataFrame:
    """'test' for hash(seed, id) < test_ratio, else 'train' (D2)."""
    u = hash01(id_col, salt=f"tt:{seed}")
    return df.withColumn(out, F.when(u < F.lit(float(test_ratio)), F.lit("test")).otherwise(F.lit("train")))


def train_val_test_split(df: DataFrame, id_col: str = "id", test_ratio: float = 0.2, val_share: float = 0.25,
                         seed=42, out: str = "split") -> DataFrame:
    """test_ratio to test, then ``val_share`` of the rest to validation (D3)."""
    is_test = (hash01(id_col, salt=f"tt:{seed}") < F.lit(float(test_ratio))).cast("int")
    is_val = (hash01(id_col, salt=f"val:{seed}") < F.lit(float(val_share))).cast("int") * (F.lit(1) - is_test)
    return df.withColumn(out, F.element_at(_names("train", "val", "test"), F.lit(1) + is_val + F.lit(2) * is_test))


def diagnosis_split(df: DataFrame, id_col: str = "id", shares=(0.6, 0.2, 0.2), seed=42,
                    out: str = "split") -> DataFrame:
    """Train / calibration / test by cumulative shares, 60/20/20 by default."""
    a, b, _ = shares
    u = hash01(id_col, salt=f"diag:{seed}")
    # index by comparisons outside any CASE: the hash is evaluated once per row
    idx = F.lit(1) + (u >= F.lit(float(a))).cast("int") + (u >= F.lit(float(a + b))).cast("int")
    return df.withColumn(out, F.element_at(_names("train", "cal", "test"), idx))


def assign_folds(df: DataFrame, id_col: str = "id", k: int = 3, seed=0, out: str = "fold") -> DataFrame:
    """Fold number floor(k · hash) in 0..k−1, usable as ``CrossValidator(foldCol=...)``."""
    u = hash01(id_col, salt=f"fold:{seed}")
    return df.withColumn(out, F.least(F.floor(u * F.lit(k)).cast("int"), F.lit(k - 1)))


def class_summary(df: DataFrame, y: str = "y") -> DataFrame:
    """Number of classes and the averaging mode they imply."""
    return df.agg(F.count_distinct(as_col(y)).alias("n_classes")).withColumn(
        "average", F.when(F.col("n_classes") > 2, F.lit("macro")).otherwise(F.lit("binary")))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(as_col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
