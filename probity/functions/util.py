"""Small column utilities shared by every module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c) -> Column:
    """Column from a name (dots and spaces allowed) or a Column."""
    if isinstance(c, Column):
        return c
    return F.col(quote(c))


def quote(name: str) -> str:
    """Backtick-quote a column name so dots and spaces are literal."""
    if name.startswith("`") and name.endswith("`"):
        return name
    return "`" + name.replace("`", "``") + "`"


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(as_col(num), as_col(den))


def zero_div(num, den) -> Column:
    """num / den, 0 when den is 0: the ``zero_division=0`` convention."""
    return F.coalesce(F.try_divide(as_col(num), as_col(den)), F.lit(0.0))


def r6(c) -> Column:
    """Round to 6 decimals: float sums differ in the last bit between plans."""
    return F.round(as_col(c), 6)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df, exclude=()) -> list[str]:
    """Names of numeric columns (all NumericType, not only float64/int64)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df, exclude=()) -> list[str]:
    """String and boolean columns: the categorical roles."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
