"""Exact quantiles by bucket counts, with linear interpolation (numpy's default).

Spark's exact ``percentile`` aggregate keeps a map of every distinct value of a
group in one task, which does not survive a 100 TB column.  Here a first pass counts
rows per (group, order bucket); running over that small table it finds the buckets that
hold the wanted positions.  A second pass reads only the rows of those buckets and finds
the values by running counts over their distinct values.  Neither pass sorts the column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.util import as_col
from probity.plans import ordering
from probity.plans.ordering import may_exceed, running_sums, with_bucket
from probity.plans.reshape import BROADCAST_ROW_LIMIT
from probity.session import cut_lineage


def order_statistics(df: DataFrame, value: str, positions, keys=(), max_groups: int | None = None) -> DataFrame:
    """(keys..., slot, value, n): the values at given 0-based positions in ascending order, and the row count.

    ``positions`` are functions from a key's row count (a Column) to a position; ``slot`` is
    a position's place in that list.  Nulls are ignored, keys without values absent.  The
    table of wanted buckets (made at once, as a job) has at most groups × positions rows: without keys, or with
    ``max_groups``, it is broadcast, otherwise AQE decides from the runtime size.
    """
    keys = list(keys)
    base = df.select(*[as_col(k).alias(k) for k in keys], as_col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    base = with_bucket(base.withColumn("_v", F.col("_v") + F.lit(0.0)), "_v", "_sb")
    each = Window.partitionBy(*keys)
    up = each.orderBy("_sb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = base.groupBy(*keys, "_sb").agg(F.count(F.lit(1)).alias("_c"))
    hist = hist.select(*keys, "_sb", "_c", F.sum("_c").over(up).alias("_cum"), F.sum("_c").over(each).alias("_n"))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), at(F.col("_n")).cast("bigint").alias("at")) for i, at in enumerate(positions)])
    first = F.col("_cum") - F.col("_c")
    wanted = hist.select(*keys, "_sb", F.filter(slots, lambda s: (s["at"] >= first) & (s["at"] < F.col("_cum"))).alias("_s"), first.alias("_first"), "_n") \
                 .where(F.size("_s") > 0)
    bounded = (max_groups or 1) * len(positions) <= BROADCAST_ROW_LIMIT if (max_groups is not None or not keys) else False
    hint = F.broadcast if bounded else (lambda x: x)
    names = [f"_wk{i}" for i in range(len(keys) + 1)]
    # cut off from the rows: the wanted buckets are read twice
    side = cut_lineage(wanted.select(*[as_col(k).alias(n) for k, n in zip([*keys, "_sb"], names)], "_s", "_first", "_n"))
    on = [as_col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_sb"], names)]
    near = base.join(hint(side.select(*names)), on, "inner").select(*keys, "_sb", "_v", F.lit(1).cast("bigint").alias("_one"))
    rs = running_sums(near, "_v", ["_one"], [*keys, "_sb"], refine=may_exceed(df, ordering.WINDOW_ROWS))
    lo, hi = F.col("_first") + F.col("cum__one") - F.col("_one"), F.col("_first") + F.col("cum__one")
    hit = rs.join(hint(side), on, "inner").select(*keys, "_v", "_n", F.explode(F.filter("_s", lambda s: (s["at"] >= lo) & (s["at"] < hi))).alias("_t"))
    return hit.select(*keys, F.col("_t.slot").alias("slot"), F.col("_v").alias("value"), F.col("_n").alias("n"))


def exact_quantiles(df: DataFrame, value: str, qs, keys=(), max_groups: int | None = None) -> DataFrame:
    """(keys..., q, quantile) for each q in ``qs``; nulls ignored, empty groups absent."""
    keys = list(keys)
    qs = [float(q) for q in qs]
    pos = lambda q: (lambda n: F.lit(q) * (n - F.lit(1)).cast("double"))
    ats = [f for q in qs for f in (lambda n, q=q: F.floor(pos(q)(n)), lambda n, q=q: F.ceil(pos(q)(n)))]
    found = order_statistics(df, value, ats, keys, max_groups)
    j = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_at"),  # 2 × len(qs) entries
                                 F.max("n").alias("_n")).where(F.col("_n").isNotNull())
    rows = F.array(*[F.struct(F.lit(q).alias("q"), F.col("_at")[2 * i].alias("a"), F.col("_at")[2 * i + 1].alias("b"),
                              (pos(q)(F.col("_n")) - F.floor(pos(q)(F.col("_n")))).alias("t")) for i, q in enumerate(qs)])
    j = j.select(*keys, F.explode(rows).alias("_r"))
    # numpy's lerp: a + (b-a)*t, or b - (b-a)*(1-t) when t >= 0.5
    a, b, t = F.col("_r.a"), F.col("_r.b"), F.col("_r.t")
    d = b - a
    val = F.when(d == 0, a).when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)
    return j.select(*keys, F.col("_r.q").alias("q"), val.alias("quantile"))


def quantile_table(df: DataFrame, value: str, qs, keys=(), method: str = "exact",
                   accuracy: int = 10000, max_groups: int | None = None) -> DataFrame:
    """Exact (rank-based) or approximate (``percentile_approx``) quantiles, long form."""
    keys = list(keys)
    if method == "exact":
        return exact_quantiles(df, value, qs, keys, max_groups)
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    g = df.groupBy(*keys).agg(F.percentile_approx(as_col(value).cast("double"), qarr, accuracy).alias("_qv"))
    return g.select(*keys, F.posexplode("_qv").alias("_i", "quantile")) \
            .withColumn("q", qarr[F.col("_i")]).drop("_i")
