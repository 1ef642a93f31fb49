"""Weak spots: segments where the model is worse than overall.

Segments are the leaves of a shallow entropy tree on one or two features that predicts
whether the model was right.  Its splits are exact: every boundary between two
neighbouring values of a feature is a candidate.  A level of the tree is one job over all
nodes and features, running class counts in value order (``running_sums``), followed by the
best boundary of each node.  Per-leaf accuracy is a grouped aggregate; the leaf table
(≤ 2^depth rows) is broadcast back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.util import as_col
from probity.plans.ordering import running_sums
from probity.plans.reshape import bounded_broadcast

SCORE_DIGITS = 6   # candidates whose entropies agree so far (in row-bits) are tied


def correctness(df: DataFrame, y: str = "y", yh: str = "yh", tolerance: float | None = None,
                out: str = "ok") -> DataFrame:
    """1 when the prediction is right (L1); for regression |y − yh| ≤ tolerance (Q14)."""
    if tolerance is None:
        cond = as_col(y) == as_col(yh)
    else:
        cond = F.abs(as_col(y).cast("double") - as_col(yh).cast("double")) <= F.lit(float(tolerance))
    return df.withColumn(out, cond.cast("int"))


@dataclass
class SegmentTree:
    """Splits by node: the root is 1, the children of i are 2i (value <= threshold) and 2i + 1."""

    features: list[str]
    max_depth: int
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        """Nodes without a split, depth first and left first."""
        nodes = {1} | {c for i in self.splits for c in (2 * i, 2 * i + 1)}
        return sorted(nodes - set(self.splits), key=lambda i: i << (self.max_depth + 1 - i.bit_length()))

    def node(self) -> Column:
        """The node in which a row ends."""
        def below(i: int) -> Column:
            if i not in self.splits:
                return F.lit(i)
            f, threshold = self.splits[i]
            return F.when(as_col(self.features[f]).cast("double") <= F.lit(threshold), below(2 * i)).otherwise(below(2 * i + 1))
        return below(1)

    def rules(self) -> list[tuple[int, str]]:
        """(leaf number, conditions) of every leaf."""
        out = []
        for number, leaf in enumerate(self.leaves()):
            path = []
            while leaf > 1:
                f, threshold = self.splits[leaf // 2]
                path.append(f"{self.features[f]} {'>' if leaf % 2 else '<='} {threshold!r}")
                leaf //= 2
            out.append((number, " AND ".join(reversed(path)) or "all rows"))
        return out


def _row_bits(rows: Column, ones: Column) -> Column:
    """rows × entropy of a share of ones, in bits."""
    part = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    n, k = rows.cast("double"), ones.cast("double")
    return part(n) - part(k) - part(n - k)


def best_splits(rows: DataFrame, features, ok: str, node: Column) -> DataFrame:
    """(node, feature, threshold): for each impure node the boundary that leaves the least entropy.

    ``feature`` is its place in ``features``; ties go to the first feature, then the smallest
    value.  Thresholds lie midway between neighbouring values.  Nodes in which no feature has
    two values are absent.
    """
    values = F.array(*[F.struct(F.lit(i).alias("feature"), as_col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    long = rows.select(node.alias("node"), as_col(ok).cast("bigint").alias("k"), F.lit(1).cast("bigint").alias("n"), F.explode(values).alias("_v")) \
               .select("node", F.col("_v.feature").alias("feature"), F.col("_v.value").alias("value"), "n", "k")
    sums = running_sums(long, "value", ["n", "k"], ["node", "feature"])
    whole = rows.groupBy(node.alias("_node")).agg(F.count(F.lit(1)).alias("_n"), F.sum(as_col(ok).cast("bigint")).alias("_k"))  # one row a node
    c = sums.join(F.broadcast(whole), F.col("node") == F.col("_node")).where(
        F.col("next_value").isNotNull() & (F.col("_k") > 0) & (F.col("_k") < F.col("_n")))
    left = _row_bits(F.col("cum_n"), F.col("cum_k"))
    right = _row_bits(F.col("_n") - F.col("cum_n"), F.col("_k") - F.col("cum_k"))
    best = c.groupBy("node").agg(F.min(F.struct(F.round(left + right, SCORE_DIGITS).alias("score"), "feature", "value", "next_value")).alias("b"))
    middle = (F.col("b.value") + F.col("b.next_value")) / F.lit(2.0)
    return best.select("node", "b.feature", F.when(middle < F.col("b.next_value"), middle).otherwise(F.col("b.value")).alias("threshold"))


def segment_tree(df: DataFrame, features, ok: str = "ok", max_depth: int = 3) -> SegmentTree:
    """Entropy tree on 1-2 features against the correctness flag (L2), one job a level.

    A null or NaN feature raises, so that no row is left without a segment unseen.
    """
    tree = SegmentTree(list(features), max_depth)
    bad = [as_col(f).isNull() | F.isnan(as_col(f).cast("double")) for f in tree.features]
    lost = df.agg(*[F.sum(b.cast("int")).alias(f"_{i}") for i, b in enumerate(bad)]).first()
    for f, count in zip(tree.features, lost):
        if count:
            raise ValueError(f"{count} rows have a null or NaN {f}: impute or drop them first")
    for level in range(max_depth):
        found = best_splits(df, tree.features, ok, tree.node()).where(F.col("node") >= F.lit(1 << level)).collect()  # ≤ 2^level rows
        tree.splits |= {r["node"]: (r["feature"], r["threshold"]) for r in found}
        if not found:
            break
    return tree


def assign_leaves(df: DataFrame, tree: SegmentTree) -> DataFrame:
    """Leaf number of each row, from 0 in depth-first order (L3)."""
    numbers = F.create_map(*[x for number, node in enumerate(tree.leaves()) for x in (F.lit(node), F.lit(number))])
    return df.withColumn("leaf", numbers[tree.node()])


def leaf_table(leaves: DataFrame, features, ok: str = "ok", min_rows: int = 5, threshold: float = 0.05) -> DataFrame:
    """Per leaf: ranges of the features, rows, share %, accuracy and the weak flag
    (accuracy below overall by more than ``threshold``, at least ``min_rows`` rows)
    (L4-L7)."""
    features = list(features)
    aggs = []
    for f in features:
        aggs += [F.min(as_col(f)).alias(f"{f}_min"), F.max(as_col(f)).alias(f"{f}_max")]
    per = leaves.groupBy("leaf").agg(*aggs, F.count(F.lit(1)).alias("count"),
                                     F.avg(as_col(ok).cast("double")).alias("accuracy"))
    overall = leaves.agg(F.count(F.lit(1)).alias("_n"), F.avg(as_col(ok).cast("double")).alias("_base"))
    j = per.crossJoin(F.broadcast(overall))
    weak = (F.col("count") >= F.lit(min_rows)) & (F.col("_base") - F.col("accuracy") > F.lit(threshold))
    return j.select("leaf", *[c for f in features for c in (f"{f}_min", f"{f}_max")], "count",
                    (F.col("count") / F.col("_n") * F.lit(100.0)).alias("share_pct"), "accuracy",
                    F.col("_base").alias("overall_accuracy"), weak.alias("weak"))


def rows_with_segment(leaves: DataFrame, table: DataFrame, min_rows: int = 5, max_depth: int = 3) -> DataFrame:
    """Rows with their segment accuracy; segments under ``min_rows`` left out."""
    t = bounded_broadcast(table.select("leaf", F.col("accuracy").alias("segment_accuracy"), F.col("count")),
                          2 ** (max_depth + 1))
    return leaves.join(t, "leaf").where(F.col("count") >= F.lit(min_rows)).drop("count")


def tree_rules(tree: SegmentTree) -> list[tuple[int, str]]:
    """Readable rules per leaf (L9, re-aimed graph)."""
    return tree.rules()


def weak_segments(df: DataFrame, features, y: str = "y", yh: str = "yh", tolerance: float | None = None,
                  threshold: float = 0.1, min_rows: int = 5, max_depth: int = 3) -> DataFrame:
    """L1-L7 in one call: correctness → tree → leaf table with weak flags."""
    flagged = correctness(df, y, yh, tolerance)
    leaves = assign_leaves(flagged, segment_tree(flagged, features, max_depth=max_depth))
    return leaf_table(leaves, features, min_rows=min_rows, threshold=threshold)
