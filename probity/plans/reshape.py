"""Wide-to-long reshaping (H1) and size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.util import as_col, quote

# A side may be broadcast when its row count is proven to be at most this.
BROADCAST_ROW_LIMIT = 1_000_000


def to_long(df: DataFrame, ids, cols, var: str = "feature", val: str = "value",
            cast: str = "double") -> DataFrame:
    """One pass that turns ``cols`` into (ids..., feature, value) rows.

    All value columns are cast to one type first (numerics to double, categoricals to
    string), as ``unpivot`` requires a common type.
    """
    ids = list(ids)
    cols = list(cols)
    if not cols:
        raise ValueError("to_long needs at least one value column")
    tmp = [f"_c{i}" for i in range(len(cols))]
    staged = df.select(*[as_col(i) for i in ids],
                       *[as_col(c).cast(cast).alias(t) for c, t in zip(cols, tmp)])
    long = staged.unpivot(ids, tmp, var, val)
    mapping = F.create_map(*[x for t, c in zip(tmp, cols) for x in (F.lit(t), F.lit(c))])
    return long.withColumn(var, mapping[F.col(var)])


def bounded_broadcast(df: DataFrame, bound: int, what: str = "") -> DataFrame:
    """Broadcast ``df`` whose row count is bounded by construction (``bound``).

    Examples of proven bounds: a one-row statistic (1), a table with one row per
    feature (number of columns), a bin grid (number of bins).  Above the limit the
    hint is not given and the optimizer plans a shuffle join.
    """
    if bound <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only after counting it; otherwise leave the join to the planner."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def select_quoted(df: DataFrame, names) -> DataFrame:
    return df.select(*[F.col(quote(n)) for n in names])


def spread_for_fanout(df: DataFrame, key=None, target: int | None = None) -> DataFrame:
    """Give a row-multiplying stage (explode × scoring) enough tasks.

    When ``df`` has fewer partitions than the cluster's default parallelism (a
    small table, or a file with few row groups), the un-multiplied rows are
    hash-repartitioned by ``key`` first: a shuffle of n rows instead of a
    fan-out of k·n rows squeezed into a few tasks.  Large inputs, which already
    have at least that many splits, are left alone (no extra shuffle).
    """
    want = target or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, as_col(key)) if key is not None else df.repartition(want)
