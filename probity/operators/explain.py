"""Explainability: permutation importance, Shapley values, LIME, partial
dependence (X1-X8, E9).

Every method here multiplies rows (features × repeats, grid points, permutation
steps).  The multiplication is an ``explode`` pipelined into the scoring stage and
followed by a partial aggregation, so the multiplied rows are never materialised
or shuffled as a whole; only grouped sums move between stages.
"""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.hashing import hash01, hash_hex, hash_long, uniforms_of_runs
from probity.functions.util import as_col, quote
from probity.operators.metrics import LOWER_IS_BETTER, evaluate
from probity.operators.scoring import Scorer, eval_kwargs
from probity.plans.ordering import number_by_hash, tie_hash
from probity.plans.quantiles import exact_quantiles
from probity.plans.reshape import bounded_broadcast, spread_for_fanout
from probity.session import cut_lineage


def _replace_features(df: DataFrame, features, key: str, value: str, kinds: dict) -> DataFrame:
    """Replace feature f by ``value`` on rows whose ``key`` column names f."""
    cols = []
    for c in df.columns:
        if c in features:
            cols.append(F.when(F.col(key) == F.lit(c), F.col(value).cast(kinds[c]))
                        .otherwise(F.col(quote(c))).alias(c))
        else:
            cols.append(F.col(quote(c)))
    return df.select(*cols)


# ------------------------------------------------------ permutation importance

def _primes_above(start: int, count: int) -> list[int]:
    """The first ``count`` primes above ``start`` (trial division; start ≈ 2^31)."""
    out, c = [], start + 1
    while len(out) < count:
        if c % 2 and all(c % d for d in range(3, int(c ** 0.5) + 1, 2)):
            out.append(c)
        c += 1
    return out


_PERM_PRIME_BASE = 2 ** 31


def permutation_importance(df: DataFrame, scorer: Scorer, features, metric: str = "ACC", y: str = "y",
                           id_col: str = "id", repeats: int = 10, seed: int = 0,
                           n_rows: int | None = None) -> DataFrame:
    """Score change when one feature is shuffled, every repeat kept.

    All n rows are numbered 0..n−1 in a hash order (``number_by_hash``).  The shuffle of
    (feature, repeat) k is the bijection i → (P_k·i + C_k) mod n with P_k a prime above
    2^31 and above n (so coprime with n): the row numbered i gives its value to the row
    numbered π_k(i), wherever in the table that is.  Only narrow (target, k, value) rows
    are shuffled; a row's label and other features travel once and meet them in the join
    that feeds the scoring.  ``id_col`` is distinct and not null.
    Returns (feature, repeat, score, importance); importance = base − score for
    higher-is-better metrics and score − base otherwise.
    """
    features = list(features)
    kinds = {f: df.schema[f].dataType.simpleString() for f in features}
    kw = eval_kwargs(scorer)
    base = evaluate(scorer.score(df), metric, y=y, **kw).select(F.col("value").alias("base"))
    n = n_rows if n_rows is not None else df.count()
    numbered = number_by_hash(df, hash01(id_col, salt=f"self:{seed}"), id_col, out="_rn").withColumn("_rn", F.col("_rn") - F.lit(1))
    combos = [(f, r) for f in features for r in range(1, repeats + 1)]
    primes = _primes_above(max(_PERM_PRIME_BASE, n), len(combos))
    wide = "decimal(38,0)" if n >= _PERM_PRIME_BASE else "bigint"   # P·i must not overflow
    offsets = [int(hashlib.md5(f"perm:{seed}:{k}".encode()).hexdigest()[:7], 16) for k in range(len(combos))]
    # values in one type that holds them all
    common = "double" if all(kinds[f] in ("double", "float", "int", "smallint", "tinyint") for f in features) else "string"
    vals = F.array(*[as_col(f).cast(common) for f in features])
    size = F.lit(max(n, 1)).cast(wide)
    rn = F.col("_rn").cast(wide)
    gifts = F.array(*[F.struct(F.pmod(F.lit(p).cast(wide) * rn + F.lit(c).cast(wide), size).cast("bigint").alias("target"),
                               F.lit(k).cast("smallint").alias("k"), F.get("_vals", F.lit(features.index(f))).alias("val"))
                      for k, ((f, _), p, c) in enumerate(zip(combos, primes, offsets))])
    donors = numbered.select("_rn", vals.alias("_vals")).select(F.explode(gifts).alias("_g")) \
                     .select(F.col("_g.target").alias("_target"), F.col("_g.k").alias("_k"), F.col("_g.val").alias("_val"))
    paired = donors.join(numbered.hint("shuffle_hash"), donors["_target"] == numbered["_rn"], "inner").drop("_target", "_rn")
    names, reps = F.array(*[F.lit(f) for f, _ in combos]), F.array(*[F.lit(r) for _, r in combos])
    paired = paired.withColumn("_feat", F.get(names, F.col("_k").cast("int"))).withColumn("_rep", F.get(reps, F.col("_k").cast("int"))).drop("_k")
    shuffled = _replace_features(paired, features, "_feat", "_val", kinds)
    scores = evaluate(scorer.score(shuffled), metric, by=["_feat", "_rep"], y=y, **kw)
    sign = -1.0 if metric.upper() in LOWER_IS_BETTER else 1.0
    return scores.crossJoin(base).select(
        F.col("_feat").alias("feature"), F.col("_rep").alias("repeat"), F.col("value").alias("score"),
        (F.lit(sign) * (F.col("base") - F.col("value"))).alias("importance"))


def importance_summary(perm: DataFrame) -> DataFrame:
    """Mean and std of the importance per feature, largest first."""
    return perm.groupBy("feature").agg(F.avg("importance").alias("importance"),
                                       F.stddev_pop("importance").alias("importance_std")) \
               .orderBy(F.col("importance").desc(), "feature")


# --------------------------------------------------------------- Shapley values

def linear_shap(df: DataFrame, weights: dict, intercept: float = 0.0, background: DataFrame | None = None,
                id_col: str = "id") -> DataFrame:
    """Exact Shapley values of a linear margin: phi_j = w_j·(x_j − mean_bg(x_j)).

    Returns (id, feature, phi, base) with base = intercept + Σ w_j·mean_bg(x_j), so
    Σ phi + base = the margin of the row.
    """
    feats = list(weights)
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(as_col(f)).alias(f"_m{i}") for i, f in enumerate(feats)])
    base = F.lit(float(intercept))
    for i, f in enumerate(feats):
        base = base + F.lit(float(weights[f])) * F.col(f"_m{i}")
    j = df.crossJoin(F.broadcast(means))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"),
                              (F.lit(float(weights[f])) * (as_col(f).cast("double") - F.col(f"_m{i}"))).alias("phi"))
                     for i, f in enumerate(feats)])
    return j.select(as_col(id_col).alias("id"), F.explode(rows).alias("_r"), base.alias("base")) \
            .select("id", "_r.feature", "_r.phi", "base")


def number_background(background: DataFrame, features, id_col: str | None = None, seed: int = 0) -> DataFrame:
    """Background rows as (_zi, _z_0.._z_k-1) with _zi = 0..n-1 in a hash order.

    Without ``id_col`` ids are content hashes plus a copy number (skew-free for duplicated
    rows); the numbering is by equal slices of the hash (``number_by_hash``), so any
    background size works."""
    from probity.sources.files import with_row_id
    values = [as_col(f).alias(f"_z_{i}") for i, f in enumerate(features)]
    if id_col is None:
        bg = with_row_id(background.select(*values), out="_bid")
        draw = tie_hash("_bid") / F.lit(float(1 << 52))
    else:
        bg = background.select(as_col(id_col).alias("_bid"), *values)
        draw = hash01("_bid", salt=f"bgn:{seed}")
    return number_by_hash(bg, draw, "_bid", out="_zi1").select(
        (F.col("_zi1") - F.lit(1)).alias("_zi"), *[f"_z_{i}" for i in range(len(values))])


def sampled_shap(df: DataFrame, scorer: Scorer, features, background: DataFrame, id_col: str = "id",
                 n_samples: int = 32, seed: int = 0, background_id: str | None = None) -> DataFrame:
    """Shapley values by sampled permutations (Strumbelj-Kononenko) for any model.

    For each row and sample m: a feature order and a background row z are drawn
    from hashes; the row is walked from z to x one feature at a time in that order
    and the score change of each step is that feature's contribution.  Per sample
    the contributions add up exactly to f(x) − f(z).  Background rows are picked by
    a hash-drawn index into the background, numbered without a single-partition
    window (``number_background``): an equi-join, no cross join, no size bound.
    Only (index, draw number) travels to the background and only the values come back;
    the row itself, its features and its sums meet them by a row number.

    The explained score is ``yh`` (regression), ``p`` (two classes) or the whole vector
    ``probs`` (more classes).  Every scored step adds to one sum per feature and class of
    its row; all steps of a row are made in one task, so they are summed up there and one
    narrow row per id shuffles.  Returns (id, feature, phi), with ``cls``
    (0-based class) between feature and phi for more than two classes.
    """
    features = list(features)
    k = len(features)
    kinds = {f: df.schema[f].dataType.simpleString() for f in features}
    bgk = number_background(background, features, background_id, seed)
    nbg = bgk.count()
    # written down once: the rows are read for the draws and again for the walk, under the same numbers
    rows = cut_lineage(spread_for_fanout(df, id_col).select(
        as_col(id_col).alias("_id"), *[as_col(f) for f in features], F.monotonically_increasing_id().alias("_row")))
    # a draw is two numbers on its way to the background, and one number and the values on its way back
    asked = rows.select("_id", "_row", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("_m")).select(
        F.floor(hash_long("_id", "_m", salt=f"bg:{seed}") / F.lit(float(1 << 60)) * F.lit(nbg)).alias("_zi"),
        (F.col("_row") * F.lit(n_samples) + F.col("_m") - F.lit(1)).alias("_draw"))
    drawn = asked.join(bgk.hint("shuffle_hash"), "_zi").select("_draw", *[f"_z_{i}" for i in range(k)])
    drawn = drawn.withColumn("_row", F.expr(f"_draw div {n_samples}"))
    ex = drawn.join(rows.hint("shuffle_hash"), "_row").withColumn("_m", F.pmod("_draw", F.lit(n_samples)).cast("int") + F.lit(1))
    # feature order: by a hash per (row, sample), ties by the feature's number
    ex = ex.select("*", *[hash_hex("_id", "_m", F.lit(f), salt=f"ord:{seed}").alias(f"_h_{i}") for i, f in enumerate(features)])
    ex = ex.select("*", *[sum(((F.col(f"_h_{j}") <= F.col(f"_h_{i}") if j < i else F.col(f"_h_{j}") < F.col(f"_h_{i}")).cast("int")
                               for j in range(k) if j != i), F.lit(0)).alias(f"_at_{i}") for i in range(k)])
    # steps 0..k: features at order positions < step come from x, the rest from z
    ex = ex.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(k))))
    places = [f"_at_{i}" for i in range(k)]
    hybrid = [F.when(F.col(places[i]) < F.col("_step"), as_col(f)).otherwise(F.col(f"_z_{i}")).cast(kinds[f]).alias(f)
              for i, f in enumerate(features)]
    scored = scorer.score(ex.select("_row", "_id", "_step", *places, *hybrid))
    outputs = _outputs(scorer)
    scored = scored.select("_row", "_id", "_step", *places, *[v.alias(f"_f_{c}") for c, v in enumerate(outputs)])
    # the score at step s counts + for the feature at position s-1 and - for the one at position s
    sums = []
    for i in range(k):
        sign = (F.col("_step") == F.col(places[i]) + F.lit(1)).cast("int") - (F.col("_step") == F.col(places[i])).cast("int")
        sums += [F.sum(F.when(sign != 0, sign * F.col(f"_f_{c}"))).alias(f"_phi_{i}_{c}") for c in range(len(outputs))]
    # all draws of a row are in one task by its number; rows of the same id then add up
    each = scored.groupBy("_row", "_id").agg(*sums)
    wide = each.groupBy(F.col("_id").alias("id")).agg(*[F.sum(c).alias(c) for c in each.columns[2:]])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cls"),
                               (F.col(f"_phi_{i}_{c}") / F.lit(float(n_samples))).alias("phi"))
                      for i, f in enumerate(features) for c in range(len(outputs))])
    long = wide.select("id", F.explode(cells).alias("_c")).select("id", "_c.feature", "_c.cls", "_c.phi")
    return long if len(outputs) > 1 else long.drop("cls")


def _outputs(scorer: Scorer) -> list:
    """Score columns that are explained: regression value, binary p, or each class's probability."""
    if scorer.task == "regression":
        return [F.col("yh").cast("double")]
    if scorer.n_classes <= 2:
        return [F.col("p").cast("double")]
    return [F.col("probs")[c].cast("double") for c in range(scorer.n_classes)]


def shap_global(phi: DataFrame, by_class: bool = False) -> DataFrame:
    """Mean |phi| per feature (summed over classes when present), largest first."""
    keys = ["feature", "cls"] if by_class else ["feature"]
    g = phi.groupBy(*keys).agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    if by_class:
        g = g.groupBy("feature").agg(F.sum("mean_abs_phi").alias("mean_abs_phi"))
    return g.orderBy(F.col("mean_abs_phi").desc(), "feature")


def shap_predicted(phi: DataFrame, rows: DataFrame, scorer: Scorer, features, id_col: str = "id") -> DataFrame:
    """Contributions to the class each row is predicted as, with the row's own values.

    ``rows`` are the explained rows with their features; they are scored again for the
    class and its score.  Returns (id, cls, feature, data, phi, base): ``data`` is the
    feature's value as double and base = f(x) − Σ phi, the mean score of the row's
    background draws.  Binary and regression scores have one output, ``cls`` 1 and null.
    """
    features = list(features)
    outputs = _outputs(scorer)
    if len(outputs) > 1:
        cls = F.col("yh").cast("int")
    else:
        cls = F.lit(None).cast("int") if scorer.task == "regression" else F.lit(1)
    scored = scorer.score(rows.select(as_col(id_col).alias("_id"), *[as_col(f) for f in features])).select(
        "_id", cls.alias("_cls"), F.get(F.array(*outputs), F.col("yh").cast("int") if len(outputs) > 1 else F.lit(0)).alias("_f"),
        *[as_col(f).cast("double").alias(f"_x_{i}") for i, f in enumerate(features)])
    per_row = phi if "cls" in phi.columns else phi.withColumn("cls", cls)
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f"_x_{i}") for i in range(len(features))]))
    mine = per_row.select("id", "feature", "cls", "phi").join(scored, F.col("id") == F.col("_id")) \
                  .where(F.col("cls").eqNullSafe(F.col("_cls")))
    gathered = mine.groupBy("id", "cls").agg(
        F.first("_f").alias("_f"), F.sum("phi").alias("_total"), F.first(values).alias("_values"),
        F.collect_list(F.struct("feature", "phi")).alias("_all"))      # one entry a feature
    return gathered.select("id", "cls", F.explode("_all").alias("_r"), "_values", (F.col("_f") - F.col("_total")).alias("base")) \
                   .select("id", "cls", "_r.feature", F.col("_values")[F.col("_r.feature")].alias("data"), "_r.phi", "base")


def shap_local(phi: DataFrame, row_id) -> DataFrame:
    """Contributions for one row, largest |phi| first.

    ``phi`` of several classes: give the rows of ``shap_predicted`` to see the predicted class."""
    return phi.where(F.col("id") == F.lit(row_id)).orderBy(F.abs("phi").desc(), "feature")


# -------------------------------------------------------------------- LIME

_KNOTS = 256       # equal steps of probability in a bin's table of quantiles


def quartile_bins(train: DataFrame, features) -> dict[str, dict]:
    """Quartile bins of every feature: inner edges, and share, mean, std, lowest and highest value per bin.

    A bin is the number of distinct quartiles below the value, so a value on an edge
    belongs to the lower bin.  Exact quartiles of all features in the same passes; one grouped pass for the bins' statistics.
    What comes to the driver is at most four rows a feature.  Nulls and NaNs are left out.
    """
    features = list(features)
    values = F.array(*[F.struct(F.lit(i).alias("i"), as_col(f).cast("double").alias("v")) for i, f in enumerate(features)])
    known = train.select(F.explode(values).alias("_c")).select("_c.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    cuts = exact_quantiles(known, "v", [0.25, 0.5, 0.75], ["i"], max_groups=len(features)).collect()   # three rows a feature
    bins = {}
    for i, f in enumerate(features):
        edges = sorted({r["quantile"] for r in cuts if r["i"] == i and r["quantile"] is not None})
        if not edges:
            raise ValueError(f"feature {f!r} has no value to cut into quartiles")
        bins[f] = {"edges": edges}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), as_col(f).cast("double").alias("v"), _bin_of(as_col(f).cast("double"), bins[f]["edges"]).alias("b"))
                      for i, f in enumerate(features)])
    stats = train.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("v").isNotNull() & ~F.isnan("v")) \
                 .groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                        F.min("v").alias("low"), F.max("v").alias("high"))
    found = {(r["i"], r["b"]): r for r in stats.collect()}
    for i, f in enumerate(features):
        edges = bins[f]["edges"]
        mine = [found.get((i, b)) for b in range(len(edges) + 1)]
        total = sum(r["n"] for r in mine if r)
        lows = [min(r["low"] for r in mine if r), *edges]
        highs = [*edges, max(r["high"] for r in mine if r)]
        bins[f].update(share=[(r["n"] if r else 0) / total for r in mine], low=lows, high=highs,
                       mean=[r["mean"] if r else 0.0 for r in mine], std=[r["std"] if r else 0.0 for r in mine])
    return bins


def _bin_of(value, edges):
    return sum(((value > F.lit(float(e))).cast("int") for e in edges), F.lit(0))


def _truncated_quantiles(mean: float, std: float, low: float, high: float) -> list[float]:
    """Quantiles of the normal (mean, std) cut to [low, high], at probabilities 0, 1/_KNOTS, ..., 1."""
    if not std > 1e-11 or not high > low:
        return [min(max(mean, min(low, high)), max(low, high))] * (_KNOTS + 1)
    normal = NormalDist(mean, std)
    a, b = normal.cdf(low), normal.cdf(high)
    if not b > a:
        return [low + (high - low) * j / _KNOTS for j in range(_KNOTS + 1)]
    inner = [a + (b - a) * j / _KNOTS for j in range(1, _KNOTS)]
    return [low, *(min(max(normal.inv_cdf(q), low), high) if 0.0 < q < 1.0 else (low if q <= 0.0 else high) for q in inner), high]


def _lime_samples(batches, tables, n_samples, salt):
    """(_id, same bin and value of every feature) of each sample of each row; sample 0 is the row itself.

    ``tables``: a feature's cumulated shares of bins, then the lower ends of its table of quantiles
    and the steps to the next ones, _KNOTS a bin.
    """
    k, at_once = len(tables), max(1, 16_384 // n_samples)
    names = ["_id", *[x for i in range(k) for x in (f"_z{i}", f"_m{i}")]]
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            rows = batch.slice(start, at_once)
            column = lambda name: rows.column(rows.schema.get_field_index(name))      # noqa: E731, B023
            ids = column("_id")
            draws = uniforms_of_runs(ids.to_pylist(), n_samples, salt, 2 * k)
            out = [ids.take(pa.array(np.repeat(np.arange(rows.num_rows), n_samples)))]
            for i, (upto, low, step) in enumerate(tables):
                bins = np.zeros(draws[0].shape, dtype=np.int64)
                for c in upto:
                    bins += draws[2 * i] >= c
                at = draws[2 * i + 1] * _KNOTS
                knot = np.minimum(at.astype(np.int64), _KNOTS - 1)
                at -= knot
                knot += bins * _KNOTS
                made = low[knot] + step[knot] * at
                same = (bins == column(f"_own{i}").to_numpy()[:, None]).astype(np.float64)
                known = column(f"_x{i}")
                made[:, 0], same[:, 0] = known.to_numpy(zero_copy_only=False), 1.0
                missing = None
                if known.null_count:
                    missing = np.zeros(made.shape, dtype=bool)
                    missing[:, 0] = known.is_null().to_numpy(zero_copy_only=False)
                    missing = missing.ravel()
                out += [pa.array(same.ravel()), pa.array(made.ravel(), pa.float64(), mask=missing)]
            yield pa.RecordBatch.from_arrays(out, names=names)


def lime(df: DataFrame, scorer: Scorer, features, train: DataFrame, id_col: str = "id", n_samples: int = 200,
         kernel_width: float | None = None, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """Local linear surrogates for every row, over quartile bins (X6, re-aimed from one row to all).

    Per row, sample and feature: a bin is drawn by the bins' shares in ``train`` and a value
    by the normal of the bin's mean and deviation cut to the bin (a table of _KNOTS quantiles,
    read linearly).  Sample 0 is the row itself.  The surrogate's inputs are 1 where the drawn
    bin is the row's own and 0 elsewhere; samples weigh by an exponential kernel on the distance
    to the all-ones row, and a ridge regression with a free intercept is fitted per row.  A
    model of more than two classes gets one surrogate a class, all from the same sums.

    A row's samples are made in one task and summed into its normal equations, so one row per
    id shuffles; the (k+1)×(k+1) solves run in pandas, a batch of rows at a time.  A null
    feature has the lowest bin and is drawn like any other.  Returns (id, feature, weight,
    intercept, score), with ``cls`` after id for more than two classes.
    """
    features = list(features)
    k = len(features)
    kw = kernel_width if kernel_width is not None else 0.75 * math.sqrt(k)
    bins = quartile_bins(train, features)
    kinds = {f: df.schema[f].dataType.simpleString() for f in features}
    ex = spread_for_fanout(df, id_col).select(
        as_col(id_col).cast("string").alias("_id"), *[as_col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    ex = ex.select("*", *[F.coalesce(_bin_of(F.col(f"_x{i}"), bins[f]["edges"]), F.lit(0)).alias(f"_own{i}") for i, f in enumerate(features)])
    tables = []
    for f in features:
        b, upto, total = bins[f], [], 0.0
        for share in b["share"][:-1]:
            total += share
            upto.append(total)
        knots = np.array([_truncated_quantiles(*cell) for cell in zip(b["mean"], b["std"], b["low"], b["high"])])
        tables.append((upto, knots[:, :-1].ravel(), np.diff(knots, axis=1).ravel()))
    drawn = ex.mapInArrow(lambda it: _lime_samples(it, tables, n_samples, f"lime:{seed}"),
                          "_id string, " + ", ".join(f"_z{i} double, _m{i} double" for i in range(k)))
    scored = scorer.score(drawn.select("_id", *[f"_z{i}" for i in range(k)], *[F.col(f"_m{i}").cast(kinds[f]).alias(f) for i, f in enumerate(features)]))
    outputs = _outputs(scorer)
    zs = [F.col(f"_z{i}") for i in range(k)]
    apart = F.lit(float(k)) - sum(zs[1:], zs[0])                   # squared distance of 0/1 rows
    sw = scored.select("_id", *zs, *[v.alias(f"_t{c}") for c, v in enumerate(outputs)],
                       F.sqrt(F.exp(-apart / F.lit(kw * kw))).alias("_w"))
    xs = [F.lit(1.0), *zs]
    # an input is 0 or 1, its own square: the diagonal stands in the first row
    sums = [F.sum(F.col("_w") * xs[a] * xs[b] if a else F.col("_w") * xs[b]).alias(f"_xx{a}_{b}") for a in range(k + 1) for b in range(a and a + 1, k + 1)]
    for c in range(len(outputs)):
        sums += [F.sum(F.col("_w") * xs[a] * F.col(f"_t{c}")).alias(f"_xy{c}_{a}") for a in range(k + 1)]
        sums.append(F.sum(F.col("_w") * F.col(f"_t{c}") * F.col(f"_t{c}")).alias(f"_yy{c}"))
    normal = sw.groupBy("_id").agg(*sums)
    classes = len(outputs)
    schema = "id string, " + ("cls int, " if classes > 1 else "") + "feature string, weight double, intercept double, score double"

    def solve(batches):
        for pdf in batches:
            m = len(pdf)
            if m == 0:
                continue
            gram = np.zeros((m, k + 1, k + 1))
            for a in range(k + 1):
                for b in range(a, k + 1):
                    gram[:, a, b] = gram[:, b, a] = pdf[f"_xx{0 if a == b else a}_{b}"].to_numpy()
            penalty = np.eye(k + 1) * ridge
            penalty[0, 0] = 0.0            # intercept is not penalised
            parts = []
            for c in range(classes):
                xy = np.stack([pdf[f"_xy{c}_{a}"].to_numpy() for a in range(k + 1)], axis=1)
                coef = np.linalg.solve(gram + penalty, xy[..., None])[..., 0]
                yy, weight = pdf[f"_yy{c}"].to_numpy(), gram[:, 0, 0]
                spread = yy - xy[:, 0] ** 2 / weight
                left = yy - 2 * np.einsum("ni,ni->n", coef, xy) + np.einsum("ni,nij,nj->n", coef, gram, coef)
                flat = spread <= 1e-12 * np.maximum(yy, 1e-300)      # the score does not move: nothing to explain
                r2 = np.where(flat, 1.0, 1 - left / np.where(flat, 1.0, spread))
                for j, name in enumerate(features):
                    part = {"id": pdf["_id"], "feature": name, "weight": coef[:, j + 1], "intercept": coef[:, 0], "score": r2}
                    if classes > 1:
                        part["cls"] = np.full(m, c, dtype=np.int32)
                    parts.append(pd.DataFrame(part))
            yield pd.concat(parts, ignore_index=True)

    return normal.mapInPandas(solve, schema)


# ---------------------------------------------------------- partial dependence

def pdp_grid(df: DataFrame, feature: str, grid_resolution: int = 100, percentiles=(0.05, 0.95)) -> DataFrame:
    """sklearn's grid: the unique values when fewer than ``grid_resolution``, else
    ``grid_resolution`` evenly spaced points between the two percentiles."""
    v = as_col(feature).cast("double")
    nd = df.agg(F.count_distinct(v).alias("n")).first()["n"]
    if nd < grid_resolution:
        return df.select(v.alias("value")).where(F.col("value").isNotNull()).distinct()
    q = exact_quantiles(df.select(v.alias("_v")), "_v", list(percentiles))
    lo_hi = q.agg(F.min("quantile").alias("_lo"), F.max("quantile").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(grid_resolution - 1))
    return lo_hi.select(F.explode(F.sequence(F.lit(0), F.lit(grid_resolution - 1))).alias("_i"), "_lo", "_hi") \
                .select(F.when(F.col("_i") == grid_resolution - 1, F.col("_hi"))
                        .otherwise(F.col("_i").cast("double") * step + F.col("_lo")).alias("value"))


def partial_dependence(df: DataFrame, scorer: Scorer, features, grid_resolution: int = 100,
                       percentiles=(0.05, 0.95)) -> DataFrame:
    """Average prediction with the feature(s) set to each grid point.

    One feature: (value, average); two features: the product grid (value_1,
    value_2, average).  The grid (≤ grid_resolution² points) is broadcast; rows ×
    grid are scored in one stage and partially aggregated per grid point before
    the only shuffle.  Catalyst prunes the row side to the columns the scorer
    still reads once the grid features are replaced.
    """
    features = [features] if isinstance(features, str) else list(features)
    grids = [pdp_grid(df, f, grid_resolution, percentiles).withColumnRenamed("value", f"value_{i + 1}")
             for i, f in enumerate(features)]
    grid = grids[0]
    for g in grids[1:]:
        grid = grid.crossJoin(g)
    # at most grid_resolution^k points: the definition of the plot, not data
    grid = bounded_broadcast(grid, grid_resolution ** len(features))
    j = spread_for_fanout(df).crossJoin(grid)
    for i, f in enumerate(features):
        j = j.withColumn(f, F.col(f"value_{i + 1}").cast(df.schema[f].dataType))
    sc = scorer.score(j)
    out = "p" if scorer.task != "regression" else "yh"
    keys = [f"value_{i + 1}" for i in range(len(features))]
    return sc.groupBy(*keys).agg(F.avg(F.col(out).cast("double")).alias("average")) \
             .select(*[F.lit(f).alias(f"feature_{i + 1}") for i, f in enumerate(features)], *keys, "average")


__all__ = ["importance_summary", "lime", "linear_shap", "partial_dependence", "pdp_grid", "quartile_bins",
           "permutation_importance", "sampled_shap", "shap_global", "shap_local", "shap_predicted"]
