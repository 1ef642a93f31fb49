"""Exact segment trees against a plain search over every boundary."""

import math

import numpy as np
import pytest

from probity.operators import weakspot

KIND = "id long, a double, b double, ok int"


def bits(n, k):
    return sum(s * x * math.log2(x) for s, x in ((1, n), (-1, k), (-1, n - k)) if x > 0)


def plain(rows, depth=3):
    """{node: (feature, threshold)} by trying every boundary of every node."""
    splits, todo = {}, [(1, rows)]
    while todo:
        node, part = todo.pop()
        n, k = len(part), sum(r[-1] for r in part)
        best = None
        for f in range(len(part[0]) - 1):
            values = sorted({r[f] for r in part})
            for v, w in zip(values, values[1:]):
                left = [r[-1] for r in part if r[f] <= v]
                key = (round(bits(len(left), sum(left)) + bits(n - len(left), k - sum(left)), 6), f, v, w)
                best = key if best is None or key < best else best
        if best is None or not 0 < k < n or node.bit_length() > depth:
            continue
        _, f, v, w = best
        mid = (v + w) / 2 if (v + w) / 2 < w else v
        splits[node] = (f, mid)
        todo += [(2 * node, [r for r in part if r[f] <= mid]), (2 * node + 1, [r for r in part if r[f] > mid])]
    return splits


def frame(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b), int(k)) for i, (a, b, k) in enumerate(rows)], KIND).repartition(3)


@pytest.mark.parametrize("seed", [0, 1])
def test_splits_equal_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 12, 300) / 4, rng.normal(size=300).round(1) * 1e9
    ok = ((a > 1.3) ^ (b > 2e8)) ^ (rng.random(300) < 0.15)
    rows = list(zip(a.tolist(), b.tolist(), ok.astype(int).tolist()))
    tree = weakspot.segment_tree(frame(spark, rows), ["a", "b"])
    assert tree.splits == plain(rows)
    one = weakspot.segment_tree(frame(spark, rows), ["b"])
    assert one.splits == plain([(r[1], r[2]) for r in rows])


def test_thresholds_between_neighbours_far_finer_than_bins(spark):
    rows = [(i / 1000, 0.0, int(i >= 777)) for i in range(1500)]
    tree = weakspot.segment_tree(frame(spark, rows), ["a"])
    assert tree.splits == {1: (0, (0.776 + 0.777) / 2)}
    assert tree.rules() == [(0, f"a <= {(0.776 + 0.777) / 2!r}"), (1, f"a > {(0.776 + 0.777) / 2!r}")]


def test_nodes_that_cannot_be_split(spark):
    same = weakspot.segment_tree(frame(spark, [(1, 2, 0), (1, 2, 1)] * 4), ["a", "b"])
    pure = weakspot.segment_tree(frame(spark, [(i, 2, 1) for i in range(9)]), ["a", "b"])
    empty = weakspot.segment_tree(frame(spark, [(1, 2, 0)]).limit(0), ["a"])
    assert same.splits == pure.splits == empty.splits == {} and same.rules() == [(0, "all rows")]
    leaves = weakspot.assign_leaves(frame(spark, [(1, 2, 0)] * 3), same)
    assert [r["leaf"] for r in leaves.collect()] == [0, 0, 0]


def test_leaf_numbers_are_depth_first(spark):
    tree = weakspot.SegmentTree(["a"], 3, {1: (0, 5.0), 3: (0, 8.0), 6: (0, 6.0)})
    assert tree.leaves() == [2, 12, 13, 7]
    df = frame(spark, [(v, 0, 1) for v in (1, 5, 5.5, 7, 9)])
    assert [r["leaf"] for r in weakspot.assign_leaves(df, tree).orderBy("a").collect()] == [0, 0, 1, 2, 3]


def test_null_features_raise(spark):
    df = spark.createDataFrame([(1, None, 0.0, 1), (2, 1.0, float("nan"), 0)], KIND)
    with pytest.raises(ValueError, match="1 rows have a null or NaN a"):
        weakspot.segment_tree(df, ["a"])
    with pytest.raises(ValueError, match="NaN b"):
        weakspot.segment_tree(df, ["b"])
