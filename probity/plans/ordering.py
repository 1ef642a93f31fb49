"""Ordered statistics without a single-partition window (H2).

AUC, ROC/PR curves, Spearman ranks, Kolmogorov-Smirnov, Wasserstein and conformal
p-values all need running sums in score order.  A plain
``Window.orderBy(score)`` without ``partitionBy`` pulls every row into one task,
which at 100 TB is a non-starter.  The plan used here instead:

1. **pre-aggregate** to one row per distinct (keys, order value): a hot value that
   holds a third of all rows becomes one row before anything is shuffled;
2. cut the order axis into **range buckets**: first by a data-independent, monotone
   function of the value (``order_bucket``), then every crowded bucket evenly between
   its own smallest and largest value (``fine_buckets``);
3. running sums **inside** each (keys, bucket) partition, plus the exclusive prefix
   of bucket totals from a small (keys × occupied buckets) table, joined back (AQE
   turns that join into a broadcast when the table is small).

Values are ordered in their own type (bigints above 2^53, decimals, dates and timestamps
keep every digit); only bucket numbers are computed through doubles, whose rounding is
monotone.

Tables that the optimizer estimates at fewer than ``WINDOW_ROWS`` rows are not cut further:
whatever their values, a bucket fits one task, and the plan stays small.

Rows per bucket: ``PER_BINADE`` coarse buckets for every power-of-two range of |value|; a
bucket of more than ``CROWDED`` distinct values is cut into ceil(distinct / PART) parts, so
values spread evenly over a bucket leave about ``PART`` in each.  The ``MAX_SPLIT`` most
crowded buckets are cut; any other holds at most 1 / MAX_SPLIT of all distinct values (or
``CROWDED``).  Values that crowd inside one part of a bucket are the remaining exception.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.util import as_col, quote
from probity.session import cut_lineage

PER_BINADE = 4096
CROWDED = 1 << 17            # distinct values of a bucket that is cut further
PART = 1 << 16               # distinct values wanted in a part of it
MAX_SPLIT = 8192             # buckets cut at most: bounds the broadcast table of cuts
_MAX_PARTS = 1 << 24
_EXP_SHIFT = 1100.0          # keeps e + shift > 0 for every finite double
_TOP = 1 << 42               # bucket for +inf / NaN (beyond every finite bucket)
WINDOW_ROWS = 1 << 21        # rows that one window may take in
_ROW_BYTES = 8               # taken for a row of an estimate
_LAST = -(1 << 62)           # bucket of rows without an order value
_HASH_BUCKETS = 1 << 16


def order_bucket(x, per_binade: int = PER_BINADE) -> Column:
    """Monotone non-decreasing bigint bucket of a double.

    For |x| in [2^e, 2^(e+1)) the value ``e + shift + |x|/2^e - 1`` is continuous and
    increasing in |x| (it is exact at every power of two whichever way ``log2``
    rounds), so ``floor(per_binade * g)`` never decreases as x grows.
    """
    x = as_col(x).cast("double")
    ax = F.abs(x)
    e = F.floor(F.log2(ax)).cast("double")
    g = e + F.lit(_EXP_SHIFT - 1.0) + ax / F.pow(F.lit(2.0), e)
    k = F.floor(g * F.lit(float(per_binade))).cast("bigint") + F.lit(1)
    return (F.when(F.isnan(x), F.lit(_TOP + 1))
             .when(x == float("inf"), F.lit(_TOP))
             .when(x == float("-inf"), F.lit(-_TOP))
             .when(x > 0, k)
             .when(x < 0, -k)
             .otherwise(F.lit(0)).cast("bigint"))


def ordered_value(df: DataFrame, order: str) -> Column:
    """The order column in its own type; doubles and floats as doubles with one zero."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return as_col(order).cast("double") + F.lit(0.0)
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return as_col(order)
    return as_col(order).cast("double") + F.lit(0.0)


def axis(value: Column, kind: T.DataType) -> Column:
    """A number that grows with the value and can be subtracted without losing digits."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    return value


def may_exceed(df: DataFrame, rows: int) -> bool:
    """Whether the optimizer's size estimate allows more than ``rows`` rows; no job runs.

    Decides between plans with the same result only.
    """
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > rows * _ROW_BYTES


def with_bucket(df: DataFrame, order: str, out: str = "__b") -> DataFrame:
    """``df`` with the coarse bucket of its order column, a value of ``ordered_value``."""
    return df.withColumn(out, order_bucket(axis(as_col(order), df.schema[order].dataType)))


def fine_buckets(pre: DataFrame, keys, order: str, bucket: str = "__b", out: str = "__f", values=()) -> DataFrame:
    """``pre`` (distinct values with their bucket) with the part of each crowded bucket; 0 in the others.

    (bucket, part) grows with the value.  The cuts are a broadcast table of at most
    MAX_SPLIT rows: (keys, bucket, smallest value, parts per unit).  The counts read ``values``
    too, so that both readers of ``pre`` need the same columns of its shuffle and share it.
    """
    ax = axis(as_col(order), pre.schema[order].dataType)
    sizes = pre.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_cn"), F.min(ax).alias("_lo"), F.max(ax).alias("_hi"),
                                              *[F.max(v).alias(f"_held{i}") for i, v in enumerate(values)])
    held = [F.col(f"_held{i}").isNotNull() for i in range(len(values))]
    parts = F.least(F.ceil(F.col("_cn") / F.lit(float(PART))), F.lit(_MAX_PARTS)).cast("double")
    cuts = sizes.where(reduce(and_, held, F.col("_cn") > F.lit(CROWDED))).orderBy(F.col("_cn").desc()).limit(MAX_SPLIT).select(
        *[F.col(quote(k)).alias(f"_ck{i}") for i, k in enumerate([*keys, bucket])], "_lo",
        F.try_divide(parts, (F.col("_hi") - F.col("_lo")).cast("double")).alias("_per"))
    on = [F.col(quote(k)).eqNullSafe(F.col(f"_ck{i}")) for i, k in enumerate([*keys, bucket])]
    part = F.floor((ax - F.col("_lo")).cast("double") * F.col("_per")).cast("bigint")
    return pre.join(F.broadcast(cuts), on, "left").select(
        *[F.col(quote(c)) for c in pre.columns], F.coalesce(part, F.lit(0).cast("bigint")).alias(out))


def distinct_values(df: DataFrame, order: str, values, keys=(), refine: bool | None = None) -> tuple[DataFrame, list[str]]:
    """Sums of ``values`` per (keys, distinct order value ``__o``) with its bucket, and the bucket's columns.

    Rows with a null order value are ignored; ``refine`` as in ``running_sums``.
    """
    src = df.select(*[as_col(k).alias(k) for k in keys], ordered_value(df, order).alias("__o"),
                    *[as_col(v).alias(v) for v in values])
    # nulls go by a count: a filter on the value itself would work out every drawn score twice, once below the projection
    sums = src.groupBy(*keys, "__o").agg(*[F.sum(v).alias(v) for v in values], F.count("__o").alias("__known"))
    pre = with_bucket(sums.where(F.col("__known") > 0).drop("__known"), "__o")
    if refine if refine is not None else may_exceed(df, WINDOW_ROWS):
        return fine_buckets(pre, keys, "__o", values=values), ["__b", "__f"]
    return pre, ["__b"]


def running_sums(df: DataFrame, order: str, values, keys=(), descending: bool = False, refine: bool | None = None) -> DataFrame:
    """Running sums of ``values`` over distinct ``order`` values within ``keys``.

    Returns one row per (keys, distinct order value) with columns
    ``keys..., <order>, <v>..., cum_<v>... (inclusive), prev_<order>, next_<order>``
    where prev/next are the neighbouring distinct values in the sort direction
    (null at the ends).  Rows with a null order value are ignored.  The order column keeps
    its type (floats become doubles).  ``refine``: whether crowded buckets are cut (default:
    unless the table is small).
    """
    keys = list(keys)
    values = list(values)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    pre, parts = distinct_values(df, order, values, keys, refine)

    w_in = Window.partitionBy(*keys, *parts).orderBy(way("__o"))
    w_run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pre = pre.select(
        "*",
        *[F.sum(v).over(w_run).alias(f"_in_{v}") for v in values],
        F.lag("__o").over(w_in).alias("_prev_in"),
        F.lead("__o").over(w_in).alias("_next_in"))

    first, last = (F.max, F.min) if descending else (F.min, F.max)
    tot = pre.groupBy(*keys, *parts).agg(
        *[F.sum(v).alias(f"_t_{v}") for v in values],
        first("__o").alias("_bfirst"), last("__o").alias("_blast"))
    w_b = Window.partitionBy(*keys).orderBy(*map(way, parts))
    w_before = w_b.rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *keys, *parts,
        *[F.coalesce(F.sum(f"_t_{v}").over(w_before), F.lit(0)).alias(f"_off_{v}") for v in values],
        F.lag("_blast").over(w_b).alias("_prev_b"),
        F.lead("_bfirst").over(w_b).alias("_next_b"))

    t = tot.alias("t")
    p = pre.alias("p")
    cond = [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col(f"p.{b}") == F.col(f"t.{b}") for b in parts]
    joined = p.join(t, cond, "inner")
    return joined.select(
        *[F.col(f"p.{k}").alias(k) for k in keys],
        F.col("p.__o").alias(order),
        *[F.col(f"p.{v}").alias(v) for v in values],
        *[(F.col(f"p._in_{v}") + F.col(f"t._off_{v}")).alias(f"cum_{v}") for v in values],
        F.coalesce(F.col("p._prev_in"), F.col("t._prev_b")).alias(f"prev_{order}"),
        F.coalesce(F.col("p._next_in"), F.col("t._next_b")).alias(f"next_{order}"),
    )


def rank_table(df: DataFrame, order: str, keys=(), out: str = "rank", value_out: str = "_v") -> DataFrame:
    """(keys..., value, average rank) per distinct value: the table behind
    ``average_ranks``, for callers that join several rank tables back at once."""
    keys = list(keys)
    base = df.select(*[as_col(k).alias(k) for k in keys], as_col(order).alias(order),
                     F.lit(1).cast("bigint").alias("_one"))
    rs = running_sums(base, order, ["_one"], keys)
    return rs.select(*keys, F.col(order).alias(value_out),
                     (F.col("cum__one") - F.col("_one") + (F.col("_one") + F.lit(1)) / F.lit(2.0)).alias(out))


def average_ranks(df: DataFrame, order: str, keys=(), out: str = "rank") -> DataFrame:
    """Attach the average (fractional) rank of ``order`` within ``keys`` to every row.

    rank = (#rows below) + (ties + 1) / 2, as ``scipy.stats.rankdata``/pandas
    ``rank()``.  Computed over distinct values, then joined back on (keys, value).
    """
    keys = list(keys)
    ranks = rank_table(df, order, keys, out)
    cond = [df[k].eqNullSafe(ranks[k]) for k in keys] + [ordered_value(df, order) == ranks["_v"]]
    joined = df.join(ranks, cond, "left")
    return joined.select(*[df[c] for c in df.columns], ranks[out])


def row_numbers(df: DataFrame, order: str, tiebreak: str, keys=(), descending: bool = False,
                out: str = "rn") -> DataFrame:
    """1-based row number in (order [desc], tiebreak asc) within ``keys``.

    ``tiebreak`` must be a non-null column whose values are distinct within keys
    (a row id).  The rank is split into three skew-safe parts:

    * rows with a strictly better order value -- running sums over distinct values;
    * rows tied on the order value with a smaller 52-bit hash of the tie-breaker --
      running sums keyed by the tied value, so a hot tie group is spread over hash
      buckets instead of one task;
    * the hash-collision remainder, ordered by the tie-breaker itself (groups of ~1).
    """
    keys = list(keys)
    base = df.withColumn("_s", ordered_value(df, order)).withColumn("_h", tie_hash(tiebreak)) \
             .withColumn("_one", F.lit(1).cast("bigint"))
    refine = may_exceed(base, WINDOW_ROWS)

    a = running_sums(base, "_s", ["_one"], keys, descending, refine).select(
        *keys, "_s", (F.col("cum__one") - F.col("_one")).alias("_below"))
    b = running_sums(base, "_h", ["_one"], keys + ["_s"], refine=refine).select(
        *keys, "_s", "_h", (F.col("cum__one") - F.col("_one")).alias("_tied_below"))
    w = Window.partitionBy(*keys, "_s", "_h").orderBy(as_col(tiebreak))
    c = base.withColumn("_coll", F.row_number().over(w) - F.lit(1))

    j = c
    for table, on in ((a, [*keys, "_s"]), (b, [*keys, "_s", "_h"])):  # null keys are a group
        names = [f"_rk{i}" for i in range(len(on))]
        side = table.select(*[as_col(k).alias(m) for k, m in zip(on, names)], table.columns[-1])
        j = j.join(side, [as_col(k).eqNullSafe(F.col(m)) for k, m in zip(on, names)], "inner").drop(*names)
    rn = (F.col("_below") + F.col("_tied_below") + F.col("_coll") + F.lit(1)).cast("bigint")
    return j.select(*[F.col(quote(x)) for x in df.columns], rn.alias(out))


def tie_hash(tiebreak) -> Column:
    """52-bit hash of a row id that orders ties."""
    return F.conv(F.substring(F.md5(as_col(tiebreak).cast("string")), 1, 13), 16, 10).cast("bigint")


# ---------------------------------------------------------- threshold searches

def top_levels(df: DataFrame, order: str, tiebreak: str, cuts, keys=(), out: str = "level",
               max_groups: int | None = None) -> DataFrame:
    """Rows of the largest ``order`` values with the first level that takes them in.

    ``cuts`` are functions from the rows of a key (a Column) to the rows of each level,
    non-decreasing, at most a few dozen.  Level i (from 1) holds the cuts[i-1] rows that
    come first by order descending, then by a hash of ``tiebreak``, then by it.  Rows
    without an order value count, but come last and are left out, as are rows that no
    level takes in.  ``max_groups`` bounds the keys (their thresholds are broadcast then).

    A threshold search, not a ranking: counts per bucket say in which bucket each cut
    falls.  Rows of all other buckets get their level from the bucket number; only rows of
    cut buckets (one per level and key) are numbered.  The counts run at once, as a job.
    """
    keys = list(keys)
    base = with_bucket(df.withColumn("_tv", ordered_value(df, order)), "_tv", "_tb").withColumn(
        "_tb", F.coalesce("_tb", F.lit(_LAST).cast("bigint")))
    hist = base.groupBy(*keys, "_tb").agg(F.count(F.lit(1)).alias("_c"))
    each = Window.partitionBy(*keys)
    down = each.orderBy(F.col("_tb").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select(*keys, "_tb", "_c", F.sum("_c").over(down).alias("_cum"), F.sum("_c").over(each).alias("_size"))
    # per level: the bucket in which it ends, how many rows of that bucket it takes, whether all
    ends = hist.groupBy(*keys).agg(*[x for i, cut in enumerate(cuts) for x in _level_end(i, cut)],
                                   F.max(F.when(_cut_inside(cuts), F.col("_c"))).alias("_fullest"))
    bs, rs = [f"_b{i}" for i in range(len(cuts))], [f"_r{i}" for i in range(len(cuts))]
    ends = ends.select(*keys, *[F.coalesce(b, F.lit(_TOP + 2).cast("bigint")).alias(b) for b in bs],  # a level without rows ends above all buckets
                       *rs, F.coalesce("_fullest", F.lit(0).cast("bigint")).alias("_fullest"))
    # cut off from the rows, as the thresholds are read several times
    names = [f"_tk{i}" for i in range(len(keys))]
    side = cut_lineage(ends.select(*[F.col(quote(k)).alias(n) for k, n in zip(keys, names)], *bs, *rs, "_fullest"))
    small = not keys or (max_groups is not None and max_groups <= MAX_SPLIT)
    on = [F.col(quote(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]

    def beside(full: bool | None = None) -> DataFrame:
        """Rows with the thresholds of their key; only keys whose cut buckets are (not) too full for a window."""
        table = side if full is None else side.where((F.col("_fullest") > F.lit(WINDOW_ROWS)) == F.lit(full))
        table = F.broadcast(table) if small else table
        return base.join(table, on, "inner") if keys else base.crossJoin(table)

    tb = F.col("_tb")
    above = sum(((F.col(b) > tb).cast("int") for b in bs), F.lit(1))               # first level that reaches the row's bucket
    cut_here = sum((((F.col(b) == tb) & F.col(r).isNotNull()).cast("int") for b, r in zip(bs, rs)), F.lit(0))
    known = F.col("_tv").isNotNull()
    out_names = [F.col(quote(c)) for c in df.columns]
    settled = beside().where(known & (cut_here == 0) & (above <= F.lit(len(cuts)))).select(*out_names, above.alias(out))

    def ranked(open_: DataFrame) -> DataFrame:
        later = sum((((F.col(b) > tb) | ((F.col(b) == tb) & F.coalesce(F.col(r) < F.col("_tr"), F.lit(False)))).cast("int") for b, r in zip(bs, rs)), F.lit(1))
        return open_.where(later <= F.lit(len(cuts))).select(*out_names, later.alias(out))

    # rows of cut buckets: in one window a bucket, or in parts where a bucket is too full for one task
    w = Window.partitionBy(*keys, "_tb").orderBy(F.col("_tv").desc(), tie_hash(tiebreak), as_col(tiebreak))
    large = may_exceed(df, WINDOW_ROWS)
    found = settled.unionByName(ranked(beside(False if large else None).where(known & (cut_here > 0)).withColumn("_tr", F.row_number().over(w))))
    if large:
        many = beside(True).where(known & (cut_here > 0))
        found = found.unionByName(ranked(row_numbers(many, "_tv", tiebreak, [*keys, "_tb"], descending=True, out="_tr")))
    return found


def _cut(cut) -> Column:
    return cut(F.col("_size")).cast("bigint")


def _cut_inside(cuts) -> Column:
    """Whether a level ends inside the bucket of a histogram row, not with it."""
    before = F.col("_cum") - F.col("_c")
    inside = F.lit(False)
    for cut in cuts:
        inside = inside | ((_cut(cut) > before) & (_cut(cut) < F.col("_cum")))
    return inside


def _level_end(i: int, cut) -> list[Column]:
    """The bucket where level i ends, and how many of its rows it takes (null: all)."""
    before, n = F.col("_cum") - F.col("_c"), _cut(cut)
    here = (n > before) & (n <= F.col("_cum"))
    return [F.max(F.when(here, F.col("_tb"))).alias(f"_b{i}"), F.max(F.when(here & (n < F.col("_cum")), n - before)).alias(f"_r{i}")]


def number_by_hash(df: DataFrame, hash01: Column, tiebreak: str, out: str = "rn") -> DataFrame:
    """1-based row number in order of a uniform draw in [0, 1), ties by ``tiebreak``.

    A hash is spread evenly whatever the data are, so equal slices of [0, 1) are balanced
    buckets: one shuffle of the rows, and a broadcast of at most _HASH_BUCKETS offsets.
    """
    base = df.withColumn("_hv", hash01).withColumn("_hb", F.floor(F.col("_hv") * F.lit(float(_HASH_BUCKETS))).cast("int"))
    before = Window.orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)  # over the counts of _HASH_BUCKETS buckets
    offsets = base.groupBy(F.col("_hb").alias("_ob")).agg(F.count(F.lit(1)).alias("_c")).select(
        "_ob", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_hb").orderBy("_hv", as_col(tiebreak))
    j = base.withColumn("_in", F.row_number().over(w)).join(F.broadcast(offsets), F.col("_hb") == F.col("_ob"))
    return j.select(*[F.col(quote(c)) for c in df.columns], (F.col("_in") + F.col("_off")).cast("bigint").alias(out))


def first_by_hash(df: DataFrame, hash01: Column, tiebreak: str, n: int) -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest draws, ties by ``tiebreak``.

    Two passes over the rows: one counts them by buckets of the draw, the other takes the
    rows up to the bucket in which the n-th falls.  Only that bucket is numbered.
    """
    bucket = F.floor(hash01 * F.lit(float(_HASH_BUCKETS))).cast("int")
    up = Window.orderBy("_ob").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # _HASH_BUCKETS rows
    cut = df.select(bucket.alias("_ob")).groupBy("_ob").agg(F.count(F.lit(1)).alias("_c")).withColumn("_cum", F.sum("_c").over(up)) \
            .where((F.col("_cum") >= F.lit(n)) & (F.col("_cum") - F.col("_c") < F.lit(n)))
    # one row, nulls if there are fewer rows; the rows are then cut by a number instead of a join
    edge = cut.agg(F.min("_ob").alias("at"), F.min(F.lit(n) - (F.col("_cum") - F.col("_c"))).alias("left")).first() if n > 0 else None
    names = [F.col(quote(c)) for c in df.columns]
    if n <= 0:
        return df.where(F.lit(False)).select(*names)
    if edge["at"] is None:
        return df.select(*names)
    taken = df.where(bucket <= F.lit(edge["at"])).withColumn("_hv", hash01)
    w = Window.partitionBy("_hb").orderBy("_hv", as_col(tiebreak))
    marked = taken.withColumn("_hb", F.floor(F.col("_hv") * F.lit(float(_HASH_BUCKETS))).cast("int")) \
                  .withColumn("_in", F.row_number().over(w))
    return marked.where((F.col("_hb") < F.lit(edge["at"])) | (F.col("_in") <= F.lit(edge["left"]))).select(*names)
