"""Registered checks: each callable takes (spark, sf_dir) and returns a DataFrame.

Every entry runs a library diagnostic over a whole fixture view (derived from the
driver tables) and rounds float outputs to 6 decimals so that the DuckDB twin in
``probity.oracle`` can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a check; ``sql`` is its DuckDB oracle (None = rows-only check)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate check {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float column; cast every integral column to bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _load_modules():
    # Importing the modules fills REGISTRY.
    from probity import checks  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_modules()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    _load_modules()
    return dict(ORACLES)


__all__ = ["ORACLES", "REGISTRY", "oracle_sql", "queries", "register", "rounded"]
