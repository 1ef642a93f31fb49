"""K-means on standardised features, all numbers of clusters and starts at once (K3-K5).

One pass over the rows per iteration serves every (k, start): the centroids of all of them
(a few hundred short vectors) are broadcast, each task adds up its rows per centroid, and
one grouped sum brings back a row per centroid.  A sweep of k = 2..10 with 10 starts takes
as many passes as its slowest start, not 90 fits.

Starts are k-means++ draws from the ``SEEDS`` rows with the smallest id hash (a bounded
sample, for the starts only); every row takes part in every iteration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.hashing import hash01
from probity.functions.util import as_col
from probity.plans.ordering import first_by_hash
from probity.plans.reshape import spread_for_fanout

SEEDS = 4_096
MAX_PASSES = 300
BLOCK = 1_024      # rows worked out at once: their distances to the starts of one k stay in a core's cache
TOLERANCE = 1e-4   # squared centroid movement at which a start has settled (features have variance 1)


@dataclass
class Clusters:
    """Best start of each k: centroids in standardised features, cost, and passes made over the rows."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    centroids: dict[int, np.ndarray]
    costs: dict[int, float]
    passes: int

    def standardised(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in self.features])
        return (x - self.mean) / self.scale


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties to the smaller number."""
    d = _squared(x, c)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ draw of k rows."""
    chosen = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = nearest(x, np.array(chosen))[1]
        total = d.sum()
        chosen.append(x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))])
    return np.array(chosen)


def _stacked(starts: dict[int, np.ndarray]) -> list[tuple[list[int], int, np.ndarray]]:
    """Starts of equal k together: (sets, k, matrix) with a row [-2c, |c|^2] a centroid, the first ones of all sets before the second ones."""
    out = []
    for k in sorted({len(c) for c in starts.values()}):
        sets = [s for s, c in starts.items() if len(c) == k]
        c = np.stack([starts[s] for s in sets], axis=1).reshape(k * len(sets), -1)
        out.append((sets, k, np.column_stack([-2 * c, (c * c).sum(axis=1)])))
    return out


def _nearest_of_all(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 where the centroid is the row's nearest, else 0; least distance) for distances centroids by sets by rows; ties to the smaller number."""
    best = d.min(axis=0)
    mine = (d == best).astype(np.float64)
    if mine.sum() != best.size:      # ties
        mine = (np.arange(len(d))[:, None, None] == d.argmin(axis=0)).astype(np.float64)
    return mine, best


def _sums(batches, model, sets):
    """Per task: (set, centroid, rows, cost, sums) of all sets; a set's cost stands with its first centroid.

    The starts of one k share one product for their distances and one for their sums.
    """
    frame, starts = model.value, sets.value
    groups, totals = _stacked(starts), {s: (np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)) for s, c in starts.items()}
    for batch in batches:
        rows = frame.standardised(batch)
        added = [(np.zeros((k * len(names), rows.shape[1] + 1)), np.zeros(len(names))) for names, k, _ in groups]
        for at in range(0, len(rows), BLOCK):
            x = rows[at:at + BLOCK]
            squares, ones = (x * x).sum(axis=1), np.column_stack([x, np.ones(len(x))])
            across = np.ascontiguousarray(ones.T)
            for (names, k, c), (sums, costs) in zip(groups, added):
                mine, best = _nearest_of_all((c @ across).reshape(k, len(names), -1))
                sums += mine.reshape(k * len(names), -1) @ ones
                costs += np.maximum(best + squares, 0.0).sum(axis=1)
        for (names, k, _), (sums, costs) in zip(groups, added):
            by_set = sums.reshape(k, len(names), -1)
            for i, s in enumerate(names):
                count, cost, total = totals[s]
                count += by_set[:, i, -1]
                cost[0] += costs[i]
                total += by_set[:, i, :-1]
    out = [(s, i, int(n[i]), float(cost[i]), v[i].tolist()) for s, (n, cost, v) in totals.items() for i in range(len(n)) if n[i] or cost[i]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()),
                                      pa.array([r[3] for r in out], pa.float64()), pa.array([r[4] for r in out], pa.list_(pa.float64()))],
                                     names=["set", "centroid", "n", "cost", "sums"])


def fit_clusters(df: DataFrame, features, ks, n_init: int = 10, seed: int = 0, id_col: str = "id", max_passes: int = MAX_PASSES) -> Clusters:
    """Best of ``n_init`` starts for every k in ``ks``, by within-cluster squared distance.

    A null or NaN feature raises.  An emptied cluster keeps its centroid.  Fewer distinct
    rows than k leave clusters empty.
    """
    features, ks = list(features), list(ks)
    cols = [as_col(f).cast("double") for f in features]
    rows = df.select(as_col(id_col).alias("_id"), *[c.alias(f"_x{i}") for i, c in enumerate(cols)])
    names = [f"_x{i}" for i in range(len(features))]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[x for c in names for x in (F.avg(c), F.stddev_pop(c), F.sum((F.col(c).isNull() | F.isnan(c)).cast("int")))]).first()
    if not stats["n"]:
        raise ValueError("no rows to cluster")
    for i, f in enumerate(features):
        if stats[3 + 3 * i]:
            raise ValueError(f"{stats[3 + 3 * i]} rows have a null or NaN {f}: impute or drop them first")
    mean = np.array([stats[1 + 3 * i] for i in range(len(features))])
    scale = np.array([stats[2 + 3 * i] or 1.0 for i in range(len(features))])
    frame = Clusters(names, mean, scale, {}, {}, 0)
    sample = first_by_hash(rows, hash01("_id", salt=f"clusters:{seed}"), "_id", SEEDS).orderBy("_id").select(*names).collect()  # at most SEEDS rows
    x = (np.array([list(r) for r in sample]) - mean) / scale
    sets = {s: plus_plus(x, k, np.random.default_rng([seed, k, i])) for s, (k, i) in enumerate((k, i) for k in ks for i in range(n_init))}
    spark, values = df.sparkSession, spread_for_fanout(rows, "_id").select(*names).persist()
    model, cost, moving, passes = spark.sparkContext.broadcast(frame), {}, dict(sets), 0
    try:
        # the pass after a start has settled gives its cost
        while moving and passes < max_passes:
            shared = spark.sparkContext.broadcast(moving)
            parts = values.mapInArrow(lambda it, shared=shared: _sums(it, model, shared), "set int, centroid int, n long, cost double, sums array<double>")
            found = parts.groupBy("set", "centroid").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                                         *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(len(names))]).collect()  # a row per centroid
            shared.unpersist()
            passes += 1
            cost |= dict.fromkeys(moving, 0.0)
            fresh = {s: c.copy() for s, c in moving.items()}
            for r in found:
                cost[r["set"]] += r["cost"]
                if r["n"]:
                    fresh[r["set"]][r["centroid"]] = [r[f"s{j}"] / r["n"] for j in range(len(names))]
            settled = [s for s, c in moving.items() if ((fresh[s] - c) ** 2).sum() <= TOLERANCE]
            sets |= {s: c for s, c in fresh.items() if s not in settled}
            moving = {s: sets[s] for s in moving if s not in settled}
    finally:
        values.unpersist()
    best = {k: min(range(i * n_init, (i + 1) * n_init), key=lambda s: (cost[s], s)) for i, k in enumerate(ks)}
    return Clusters(features, mean, scale, {k: sets[s] for k, s in best.items()}, {k: cost[s] for k, s in best.items()}, passes)


def assign_clusters(df: DataFrame, clusters: Clusters, out: str = "clusters") -> DataFrame:
    """``df`` with ``out``: array of (k, cluster), one entry for each k fitted."""
    model = df.sparkSession.sparkContext.broadcast(clusters)
    kinds = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("cluster", T.IntegerType())]))
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, kinds)])

    def assign(batches):
        fitted = model.value
        kind = pa.list_(pa.struct([("k", pa.int32()), ("cluster", pa.int32())]))
        for batch in batches:
            x = fitted.standardised(batch)
            near = [nearest(x, c)[0].astype(np.int32) for c in fitted.centroids.values()]
            ks = np.tile(np.array(list(fitted.centroids), dtype=np.int32), len(x))
            pairs = pa.StructArray.from_arrays([pa.array(ks), pa.array(np.stack(near, axis=1).ravel())], names=["k", "cluster"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(near), pa.int32()), pairs).cast(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return df.select(*[as_col(f.name) for f in kept]).mapInArrow(assign, schema)
