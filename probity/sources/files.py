"""Sources and sinks.

Files are read with Spark's readers (lazy, pushed-down, split across tasks);
nothing is read through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.hashing import hash01
from probity.functions.util import quote
from probity.plans.ordering import first_by_hash


@dataclass(frozen=True)
class DatasetSpec:
    """One catalogue entry."""

    key: str
    task: str
    target: str
    rows: int | None
    features: int | None
    description: str
    source: str
    drop: tuple = ()
    sample: int | None = None


# The reference's two credit presets and their documented sizes.
CATALOG = (
    DatasetSpec("gmsc", "classification", "SeriousDlqin2yrs", 150000, 10,
                "credit risk, 30,000 rows sampled", "cs-training.csv", ("Unnamed: 0",), 30000),
    DatasetSpec("taiwan_credit", "classification", "default.payment.next.month", 30000, 23,
                "credit card default", "UCI_Credit_Card.csv", ("ID",), None),
)


def catalog(spark: SparkSession) -> DataFrame:
    """The dataset registry as a DataFrame."""
    rows = [(d.key, d.task, d.target, d.rows, d.features, d.description, d.source) for d in CATALOG]
    return spark.createDataFrame(rows, "key string, task string, target string, rows long, features long, "
                                       "description string, source string")


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             nan_to_null: bool = True) -> DataFrame:
    """CSV with a header row; explicit schema when known, else inferred.

    Literal 'NaN' values become null so that only null means missing.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if not nan_to_null:
        return df
    cols = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_row_id(df: DataFrame, key_cols=None, out: str = "id") -> DataFrame:
    """Stable row id: the key columns joined, or, without keys, a hash of the row
    content plus a copy number among identical rows.

    Without keys the rows are grouped by their full content and re-expanded with
    ``sequence(1, count)``: identical rows need no ordering among themselves, a
    hot duplicate collapses to one row before the shuffle, and the ids do not
    depend on file layout (unlike ``monotonically_increasing_id``).
    """
    if key_cols:
        return df.withColumn(out, F.concat_ws("-", *[F.col(quote(c)).cast("string") for c in key_cols]))
    cols = [F.col(quote(c)) for c in df.columns]
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    content = F.md5(F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns])))
    return grouped.select(*cols, content.alias("_content"),
                          F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_k")) \
                  .withColumn(out, F.concat_ws("-", "_content", F.col("_k").cast("string"))) \
                  .drop("_content", "_k")


def prepare_preset(df: DataFrame, spec: DatasetSpec, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Apply a preset's handling: drop columns if present, drop rows with any null
    and keep ``sample`` rows chosen by a hash of the id (S2, S3)."""
    out = df.drop(*[c for c in spec.drop if c in df.columns]).na.drop(how="any")
    if spec.sample:
        out = first_by_hash(out, hash01(id_col, salt=f"sample:{seed}"), id_col, spec.sample)
    return out


def load_preset(spark: SparkSession, key: str, directory: str, id_cols=None) -> tuple[DataFrame, DatasetSpec]:
    """Read a catalogue entry's CSV from ``directory`` and apply its handling."""
    spec = {d.key: d for d in CATALOG}[key]
    raw = load_csv(spark, f"{directory}/{spec.source}")
    return prepare_preset(with_row_id(raw, id_cols), spec), spec


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First n rows (S5); a preview is the feature, so a limit is right here."""
    return df.limit(n)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table."""
    df.write.mode(mode).format(fmt).save(path)
