"""Tree models fitted on counted cells of binned features.

Before it grows a tree, MLlib cuts every feature at no more than ``maxBins`` - 1 thresholds,
found in a sample of max(``maxBins``^2, 10,000) rows; from then on rows with equal bins and
label are equal to every split.  Here the same rule finds the thresholds, one pass counts
the rows of each cell (bins and label; for regression bins, with the mean label), and MLlib
fits on the cells, weighted by their counts, however many rows stand behind them.  A split
of a weighted mean label gains what it gains over the rows, as the spread inside a cell is
the same on both sides.  A forest's bootstrap stays that of rows: a tree takes each row as
often as a Poisson draw of mean 1 says, so n equal rows a Poisson draw of mean n.

Fitted models take bins as input, so their pipelines begin with a ``Bucketizer``.  Small tables, rows
that MLlib refuses, settings that weights cannot stand for, and tables whose cells
are hardly fewer than their rows are left to MLlib's own fit over rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.util import as_col, count_if

BINNED_ROWS = 100_000        # training rows from which cells are counted
ROWS_PER_CELL = 4            # mean rows of a cell from which they pay
CELLS_PER_PART = 60_000
MOST_CELLS = 1 << 22        # cells that one task holds to grow a tree of a forest
HOT_ROWS = 1 << 21           # rows of one cell that one task draws for
BIN = "_bin"                 # prefix of the columns of bins
_SAMPLE = 10_000
_TREES = (DecisionTreeClassifier, DecisionTreeRegressor)
_FORESTS = (RandomForestClassifier, RandomForestRegressor)
_BOOSTED = (GBTClassifier, GBTRegressor)
_CLASSIFIERS = (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier)


def fits_on_cells(est) -> bool:
    """Whether weighted cells stand for rows under the estimator's settings."""
    if not isinstance(est, _TREES + _FORESTS + _BOOSTED) or est.isSet("weightCol") or est.getMinWeightFractionPerNode() > 0:
        return False
    if isinstance(est, _TREES):
        return True
    if est.getSubsamplingRate() != 1.0:
        return False
    if isinstance(est, _FORESTS):
        return est.getBootstrap() and est.getFeatureSubsetStrategy() in ("auto", "all", "sqrt", "onethird") and (
            isinstance(est, RandomForestRegressor) or est.getImpurity() == "gini")
    return not est.isSet("validationIndicatorCol") and not (isinstance(est, GBTRegressor) and est.getLossType() != "squared")


def parts_of(pipeline) -> tuple[VectorAssembler, object] | None:
    """Assembler and estimator of a pipeline that can be fitted on cells."""
    stages = pipeline.getStages() if isinstance(pipeline, Pipeline) else []
    if len(stages) == 2 and isinstance(stages[0], VectorAssembler) and stages[0].getHandleInvalid() == "error" and fits_on_cells(stages[1]) \
            and stages[1].getFeaturesCol() == stages[0].getOutputCol():
        return stages[0], stages[1]
    return None


def takes_bins(model) -> bool:
    """Whether a fitted pipeline begins with the bins of its features."""
    return isinstance(model.stages[0], Bucketizer)


def usable(df: DataFrame, features, label: str) -> bool:
    kinds = [df.schema[c].dataType for c in [*features, label]]
    return len(set(features)) == len(features) and all(isinstance(k, T.NumericType) for k in kinds)


def refused(features, label: str):
    """Rows that a fit over rows would stop at, or that thresholds cannot cut."""
    out = F.lit(False)
    for c in [*features, label]:
        v = as_col(c).cast("double")
        out = out | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return out


def cut_points(values: np.ndarray, max_bins: int) -> list[float]:
    """MLlib's thresholds of a continuous feature: between all neighbouring values, or about every len / max_bins rows."""
    v, counts = np.unique(values, return_counts=True)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(v) <= max_bins:
        return np.unique(middle).tolist()
    stride, out = len(values) / max_bins, []
    upto, target = np.cumsum(counts).tolist(), len(values) / max_bins
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(float(middle[i - 1]))
            target += stride
    return sorted(set(out))


def sample_share(max_bins: int, n: int) -> float:
    """Share of the rows that MLlib looks at for its thresholds."""
    return min(1.0, max(max_bins * max_bins, _SAMPLE) / n)


def _edges(cuts: list[float]) -> list[float]:
    """Bucketizer's splits: a value at a threshold lies below it, as in a tree."""
    inner = np.nextafter(np.array(cuts or [0.0]), np.inf).tolist()
    return [-math.inf, *sorted(set(inner)), math.inf]


def bucketizer(features, cuts) -> Bucketizer:
    return Bucketizer(inputCols=list(features), outputCols=[f"{BIN}{i}" for i in range(len(features))], splitsArray=[_edges(c) for c in cuts])


def as_class(col, k: int):
    """A label column that says its number of classes, so that no fit has to look for it."""
    return col.cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": k}})


class Cells:
    """Counted cells of training rows, on which any of the tree models is fitted."""

    def __init__(self, bucket: Bucketizer, cells: DataFrame, n_cells: int, n_rows: int, classes: int | None, rows: DataFrame | None = None):
        """``cells``: bins, label and count ``_n``; ``rows``: bins and label of every row (regression forests)."""
        self.bucket, self.n_rows, self.n_cells, self.classes, self.rows = bucket, n_rows, n_cells, classes, rows
        self.bins = bucket.getOutputCols()
        cores = cells.sparkSession.sparkContext.defaultParallelism
        self.parts = max(1, min(cores, -(-n_cells // CELLS_PER_PART)))
        label = as_class(F.col("label"), classes) if classes else F.col("label")
        # ordered numbers to the fits: Bucketizer marks its bins as categories
        number = {"ml_attr": {"type": "numeric"}}
        self.cells = cells.select(*[F.col(b).alias(b, metadata=number) for b in self.bins], label, F.col("_n").cast("double").alias("_n")).coalesce(self.parts).persist()

    def free(self) -> None:
        self.cells.unpersist()

    def _settings(self, est, weight: str, seen: float) -> dict:
        """The estimator's settings over cells: all bins as found, node sizes by weight."""
        need = est.getMinInstancesPerNode()
        out = {est.weightCol: weight, est.labelCol: "label", est.maxBins: max(est.getMaxBins(), math.isqrt(self.n_cells) + 1), est.minInstancesPerNode: 1}
        return out | ({est.minWeightFractionPerNode: (need - 0.5) / seen} if need > 1 else {})

    def fit(self, assembler: VectorAssembler, est) -> PipelineModel | None:
        """The pipeline fitted on the cells; None if a node's least size is not to be had by weight."""
        if 2 * est.getMinInstancesPerNode() >= self.n_rows:
            return None
        vectors = VectorAssembler(inputCols=self.bins, outputCol=assembler.getOutputCol(), handleInvalid="error")
        table = vectors.transform(self.cells)
        model = self._forest(est, vectors) if isinstance(est, _FORESTS) else est.copy(self._settings(est, "_n", self.n_rows)).fit(table)
        return PipelineModel(stages=[self.bucket, vectors, model])

    def _forest(self, est, vectors: VectorAssembler):
        """A forest whose trees are grown side by side, each in one task, on the cells with its own draws."""
        trees, k, seed = est.getNumTrees(), len(self.bins), est.getSeed()
        strategy = est.getFeatureSubsetStrategy()
        if strategy == "auto":
            strategy = "all" if trees == 1 else "sqrt" if self.classes else "onethird"
        tried = {"all": k, "sqrt": math.ceil(math.sqrt(k)), "onethird": math.ceil(k / 3.0)}[strategy]
        settings = (self.classes, est.getMaxDepth(), tried, est.getMinInstancesPerNode(), est.getMinInfoGain())
        drawn = draw_rows(self.cells if self.classes else self.rows.withColumn("_n", F.lit(1.0)), self.cells, self.bins, bool(self.classes), trees, seed)
        grown = drawn.groupBy("tree").applyInArrow(lambda block: _grown(block, k, settings, seed), "tree int, nodes binary").collect()
        return _joined(est, {r["tree"]: pickle.loads(r["nodes"]) for r in grown}, k, self.classes)


def _joined(est, grown: dict, k: int, classes: int | None):
    """MLlib's forest model of grown trees; as there, leaves beside each other that predict one class are one."""
    sc = SparkContext._active_spark_context
    ml, impurity, number = sc._jvm.org.apache.spark.ml, sc._jvm.org.apache.spark.mllib.tree.impurity, sc._jvm.double
    # looked up once: each look-up of a class asks the JVM several times
    leaf, inner, split_at, measure = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit, impurity.GiniCalculator if classes else impurity.VarianceCalculator

    def stats(values):
        out = sc._gateway.new_array(number, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return measure(out, int(sum(values) if classes else values[0]))

    def shape(nodes, at: int):
        """(prediction, impurity, stats, split or None, children)"""
        guess, dirt, values, split = nodes[at]
        if split is None:
            return guess, dirt, values, None, ()
        left, right = shape(nodes, 2 * at), shape(nodes, 2 * at + 1)
        if left[3] is None and right[3] is None and left[0] == right[0]:
            return guess, dirt, values, None, ()
        return guess, dirt, values, split, (left, right)

    def node(x):
        guess, dirt, values, split, below = x
        if split is None:
            return leaf(guess, dirt, stats(values))
        feature, cut, gain = split
        return inner(guess, dirt, gain, node(below[0]), node(below[1]), split_at(feature, cut), stats(values))

    kind = ml.classification.DecisionTreeClassificationModel if classes else ml.regression.DecisionTreeRegressionModel
    trees = sc._gateway.new_array(kind, len(grown))
    for i, t in enumerate(sorted(grown)):
        root = node(shape(grown[t], 1))
        trees[i] = kind(f"{est.uid}_{t}", root, k, classes) if classes else kind(f"{est.uid}_{t}", root, k)
    if classes:
        java, wrap = ml.classification.RandomForestClassificationModel(est.uid, trees, k, classes), RandomForestClassificationModel
    else:
        java, wrap = ml.regression.RandomForestRegressionModel(est.uid, trees, k), RandomForestRegressionModel
    est._transfer_params_to_java()
    return wrap(est._java_obj.copyValues(java, est._java_obj.extractParamMap()))


def _impurity(stats: np.ndarray, classes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity (Gini or variance) of class weights or of (weight, sum, sum of squares) on the first axis."""
    weight = stats.sum(axis=0) if classes else stats[0]
    some = np.where(weight > 0, weight, 1.0)
    if classes:
        return weight, 1.0 - ((stats / some) ** 2).sum(axis=0)
    return weight, (stats[2] - stats[1] * stats[1] / some) / some


def grow_tree(codes: np.ndarray, stats: np.ndarray, classes: int | None, depth: int, tried: int, least: int, min_gain: float, rng) -> dict:
    """{place in the heap: (prediction, impurity, stats, (feature, cut, gain) or None)} of one tree, grown a level at a time as MLlib does.

    ``codes``: bins of each cell; ``stats``: class weights, or weight, sum and sum of squares of the label, by cells.
    """
    out, k = {}, codes.shape[1]
    at = np.ones(len(codes), dtype=np.int64)
    for level in range(depth + 1):
        places, node = np.unique(at, return_inverse=True)
        if places[0] < 1 << level:          # 0: cells in leaves
            keep = at > 0
            codes, stats, at = codes[keep], stats[:, keep], at[keep]
            if not len(at):
                break
            places, node = np.unique(at, return_inverse=True)
        m = len(places)
        total = np.stack([np.bincount(node, x, m) for x in stats])
        weight, dirt = _impurity(total, classes)
        best = np.full(m, -np.inf)
        feature, cut = np.zeros(m, dtype=int), np.zeros(m, dtype=int)
        if level < depth:
            looked = np.argsort(rng.random((m, k)), axis=1)[:, :tried]
            for f in range(k):
                width = int(codes[:, f].max()) + 1
                if width < 2:
                    continue
                left = np.stack([np.bincount(node * width + codes[:, f], x, m * width).reshape(m, width) for x in stats]).cumsum(axis=2)[:, :, :-1]
                wl, il = _impurity(left, classes)
                wr, ir = _impurity(total[:, :, None] - left, classes)
                gain = dirt[:, None] - wl / weight[:, None] * il - wr / weight[:, None] * ir
                gain[(wl < least) | (wr < least) | (gain < min_gain) | ~(looked == f).any(axis=1)[:, None]] = -np.inf
                here = gain.argmax(axis=1)
                value = gain[np.arange(m), here]
                better = value > best
                best[better], feature[better], cut[better] = value[better], f, here[better]
        splits = best > 0
        for i, place in enumerate(places.tolist()):
            guess = float(total[:, i].argmax()) if classes else float(total[1, i] / total[0, i])
            out[place] = (guess, float(dirt[i]), total[:, i].tolist(), (int(feature[i]), cut[i] + 0.5, float(best[i])) if splits[i] else None)
        right = codes[np.arange(len(node)), feature[node]] > cut[node]
        at = np.where(splits[node], 2 * at + right, 0)
    return out


def _grown(block: pa.Table, k: int, settings: tuple, seed: int) -> pa.Table:
    """One tree of all cells that it has drawn."""
    classes = settings[0]
    col = {n: np.frombuffer(b"".join(block.column(n).to_pylist()), dtype=d) for n, d in (("codes", np.int32), ("w", float), ("s", float))}
    codes, w, s = col["codes"].reshape(-1, k), col["w"], col["s"]
    some = w > 0
    codes, w, s = codes[some].astype(np.int64), w[some], s[some]
    order = np.lexsort((*codes.T[::-1], s))              # the same sums in any layout
    codes, w, s = codes[order], w[order], s[order]
    stats = np.stack([w * (s == c) for c in range(classes)]) if classes else np.stack([w, s, s * s / w])
    tree = block.column("tree")[0].as_py()
    nodes = grow_tree(codes, stats, *settings, np.random.default_rng([seed & 0xFFFFFFFF, 1, tree]))
    return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([pickle.dumps(nodes)], pa.binary())})


def draw_rows(rows: DataFrame, cells: DataFrame, bins, labelled: bool, trees: int, seed: int) -> DataFrame:
    """(tree, codes, w, s): for each tree, blocks of cells with the number of their rows that it draws and, as ``s``, the cell's class or the sum of the drawn labels.

    Rows of a cell are sorted by label and their draws seeded by its bins, so they are the same in any layout.
    Cells of more than HOT_ROWS rows are drawn for in several parts.
    """
    if labelled:
        rows = rows.select(*bins, "label", "label", "_n").toDF(*bins, "_part", "label", "_n").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    else:
        hot = cells.where(F.col("_n") > HOT_ROWS).select(*[F.col(b).alias(f"_h{b}") for b in bins], F.ceil(F.col("_n") / HOT_ROWS).alias("_parts"))
        rows = rows.join(F.broadcast(hot), [F.col(b) == F.col(f"_h{b}") for b in bins], "left") \
                   .withColumn("_part", F.coalesce(F.pmod(F.xxhash64("label"), "_parts"), F.lit(0)).cast("double"))
        rows = rows.select(*bins, "_part", "label", "_n").repartition(*[F.col(c) for c in [*bins, "_part"]]).sortWithinPartitions(*bins, "_part", "label")
    k = len(bins)
    return rows.mapInArrow(lambda it: _draws(it, k, trees, seed, labelled), "tree int, codes binary, w binary, s binary")


def _draws(batches, k: int, trees: int, seed: int, labelled: bool, chunk: int = 4096, block: int = 2048):
    """Blocks of the draws of neighbouring rows with equal bins and part, or of labelled cells, a row a tree."""
    def table(done):
        codes = np.array([key[:k] for key, _, _ in done], dtype=np.int32).tobytes()
        w = np.ascontiguousarray(np.array([x for _, x, _ in done]).T)
        s = np.ascontiguousarray(np.array([[key[k]] * trees if labelled else x for key, _, x in done], dtype=float).T)
        return pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array([codes] * trees, pa.binary()), pa.array([x.tobytes() for x in w], pa.binary()),
                                           pa.array([x.tobytes() for x in s], pa.binary())], names=["tree", "codes", "w", "s"])

    done, last, rng = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + 3)]
        by, y, n = np.stack(cols[:k + 1], axis=1), cols[k + 1], cols[k + 2]
        starts = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]).any(axis=1)])).tolist()
        for a, b in zip(starts, [*starts[1:], len(by)]):
            key = tuple(by[a].tolist())
            if key != last:
                if len(done) >= block:
                    yield table(done)
                    done = []
                last, rng = key, np.random.default_rng([seed & 0xFFFFFFFF, *map(int, key)])
                done.append([key, np.zeros(trees), np.zeros(trees)])
            for i in range(a, b, chunk):
                p = rng.poisson(n[i:min(b, i + chunk), None], (min(b, i + chunk) - i, trees))
                done[-1][1] += p.sum(axis=0)
                if not labelled:
                    done[-1][2] += y[i:min(b, i + chunk)] @ p
    if done:
        yield table(done)


def cells_of(data: DataFrame, features, label: str, max_bins: int, classification: bool, seed: int = 0) -> Cells | None:
    """The cells of ``data`` (read three times; persist it first), or None where rows are to be fitted."""
    features = list(features)
    if not usable(data, features, label):
        return None
    n, bad, top = data.agg(F.count(F.lit(1)), count_if(refused(features, label)), F.max(as_col(label))).first()
    if n < BINNED_ROWS or bad or (classification and top < 1):
        return None
    sample = data.select(*[as_col(f).cast("double") for f in features]).sample(False, sample_share(max_bins, n), seed).collect()
    values = np.array([tuple(r) for r in sample], dtype=float).reshape(-1, len(features))
    if not len(values):
        return None
    bucket = bucketizer(features, [cut_points(values[:, i], max_bins) for i in range(len(features))])
    bins = bucket.getOutputCols()
    rows = bucket.transform(data.select(*[as_col(f) for f in features], as_col(label).cast("double").alias("_label"))).select(*bins, F.col("_label").alias("label"))
    if classification:
        cells = rows.groupBy(*bins, "label").agg(F.count(F.lit(1)).alias("_n"))
    else:
        cells = rows.groupBy(*bins).agg(F.avg("label").alias("label"), F.count(F.lit(1)).alias("_n"))
    cells = cells.persist()
    try:
        m = cells.count()
        if m * ROWS_PER_CELL > n or m > MOST_CELLS:
            return None
        out = Cells(bucket, cells, m, n, int(top) + 1 if classification else None, rows)
        out.cells.count()
        return out
    finally:
        cells.unpersist()


def fit(pipeline, data: DataFrame, kept: dict | None = None):
    """``pipeline.fit(data)``, on counted cells where they stand for the rows.

    ``kept``: cells by their settings, for several fits over the same ``data``; whoever made it frees them.
    """
    parts = parts_of(pipeline)
    if parts is None:
        return pipeline.fit(data)
    assembler, est = parts
    classification, mine = isinstance(est, _CLASSIFIERS), kept if kept is not None else {}
    key = (tuple(assembler.getInputCols()), est.getLabelCol(), est.getMaxBins(), classification)
    if key not in mine:
        mine[key] = cells_of(data, key[0], key[1], key[2], classification)
    model = mine[key].fit(assembler, est) if mine[key] is not None else None
    if kept is None:
        free(mine)
    return model if model is not None else pipeline.fit(data)


def free(kept: dict) -> None:
    for cells in kept.values():
        if cells is not None:
            cells.free()
