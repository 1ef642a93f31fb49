"""Skew-safe ordered statistics against brute force."""

import collections
import datetime
import decimal
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probity.plans import ordering
from probity.plans.ordering import average_ranks, first_by_hash, number_by_hash, order_bucket, row_numbers, running_sums, top_levels
from probity.plans.quantiles import exact_quantiles


def _buckets(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [r["b"] for r in df.select(order_bucket("x").alias("b")).collect()]


def test_order_bucket_monotone_near_powers_of_two(spark):
    vals = []
    for e in range(-30, 30):
        p = 2.0 ** e
        vals += [math.nextafter(p, 0), p, math.nextafter(p, math.inf), -p, -math.nextafter(p, 0)]
    vals += [0.0, -0.0, 1e-300, -1e-300, 5e-324, 1.7e308, -1.7e308, 0.3, 0.30000000000000004]
    vals = sorted(vals)
    b = _buckets(spark, vals)
    assert all(x <= y for x, y in zip(b, b[1:]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=2, max_size=200))
def test_order_bucket_monotone_random(spark, xs):
    xs = sorted(xs)
    b = _buckets(spark, xs)
    assert all(x <= y for x, y in zip(b, b[1:]))


def _random_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(["a", "b", "c"])
        # a hot value holding a third of the rows, plus ties and spread values
        v = 0.5 if i % 3 == 0 else round(rng.uniform(-3, 3), 1) * (10 ** rng.randint(-2, 2))
        rows.append((i, k, float(v), rng.randint(0, 5)))
    return rows


def test_running_sums_matches_bruteforce(spark):
    rows = _random_rows()
    df = spark.createDataFrame(rows, "id long, k string, v double, w long").repartition(7)
    got = {(r["k"], r["v"]): (r["w"], r["cum_w"], r["prev_v"], r["next_v"])
           for r in running_sums(df, "v", ["w"], ["k"]).collect()}
    for k in "abc":
        vals = sorted({v for _, kk, v, _ in rows if kk == k})
        for i, v in enumerate(vals):
            w = sum(x[3] for x in rows if x[1] == k and x[2] == v)
            cum = sum(x[3] for x in rows if x[1] == k and x[2] <= v)
            prev = vals[i - 1] if i > 0 else None
            nxt = vals[i + 1] if i + 1 < len(vals) else None
            assert got[(k, v)] == (w, cum, prev, nxt)


def test_running_sums_descending_and_partition_invariance(spark):
    rows = _random_rows(300, seed=3)
    df = spark.createDataFrame(rows, "id long, k string, v double, w long")
    a = sorted(tuple(r) for r in running_sums(df.repartition(1), "v", ["w"], descending=True).collect())
    b = sorted(tuple(r) for r in running_sums(df.repartition(9), "v", ["w"], descending=True).collect())
    assert a == b
    for r in a:
        v, cum = r[0], r[2]
        assert cum == sum(x[3] for x in rows if x[2] >= v)


def test_average_ranks(spark):
    rows = _random_rows(200, seed=5)
    df = spark.createDataFrame(rows, "id long, k string, v double, w long")
    got = {r["id"]: r["rank"] for r in average_ranks(df, "v", ["k"]).collect()}
    for i, k, v, _ in rows:
        same = [x for x in rows if x[1] == k]
        below = sum(1 for x in same if x[2] < v)
        ties = sum(1 for x in same if x[2] == v)
        assert got[i] == below + (ties + 1) / 2


def test_row_numbers_hot_ties(spark):
    rows = _random_rows(300, seed=7)
    df = spark.createDataFrame(rows, "id long, k string, v double, w long").repartition(5)
    out = row_numbers(df, "v", "id", ["k"], descending=True).collect()
    for k in "abc":
        rn = sorted(r["rn"] for r in out if r["k"] == k)
        assert rn == list(range(1, len(rn) + 1))
        # order respects v descending
        by_rn = sorted((r["rn"], r["v"]) for r in out if r["k"] == k)
        assert all(a[1] >= b[1] for a, b in zip(by_rn, by_rn[1:]))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500), np.full(200, 1.5)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(6)
    qs = [0.0, 0.1, 0.25, 0.30000000000000004, 0.5, 0.75, 0.95, 1.0]
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "v", qs).collect()}
    for q in qs:
        assert math.isclose(got[q], float(np.percentile(x, q * 100)), rel_tol=0, abs_tol=1e-12)


# ------------------------------------------------------- crowded buckets and own types

def _spread(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").withColumn("w", F.lit(1).cast("bigint")).repartition(5)


def _crowd(df):
    """Distinct values in the fullest (bucket, part) and in the fullest coarse bucket."""
    pre = ordering.with_bucket(df.where("v is not null").select("v").distinct(), "v")
    sizes = ordering.fine_buckets(pre, [], "v").groupBy("__b", "__f").agg(F.count("*").alias("n")).collect()
    coarse = {}
    for r in sizes:
        coarse[r["__b"]] = coarse.get(r["__b"], 0) + r["n"]
    return max(r["n"] for r in sizes), max(coarse.values())


def _cases():
    start = datetime.date(2019, 1, 1)
    seconds = [1_700_000_000 + 7 * i for i in range(6_000)]
    return {
        "epoch seconds": ("bigint", seconds),
        "epoch seconds as doubles": ("double", [float(s) for s in seconds]),
        "one old value before them": ("bigint", [0, *seconds]),
        "date codes": ("int", [20_190_000 + i for i in range(4_000)]),
        "dates": ("date", [start + datetime.timedelta(days=i) for i in range(2_500)]),
        "timestamps": ("timestamp", [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i) for i in range(3_000)]),
        "decimals": ("decimal(20,2)", [decimal.Decimal(10 ** 15) + decimal.Decimal(i) / 100 for i in range(2_000)]),
        "a hot value": ("double", [5.5] * 1_500 + [i / 700 for i in range(3_000)]),
        "around 2^53": ("bigint", [2 ** 53 + i for i in range(4)] * 3 + [-(2 ** 53) - 1, -(2 ** 53), 0]),
        "ends of the range": ("bigint", [2 ** 63 - 1, 2 ** 63 - 2, -(2 ** 63), -(2 ** 63) + 1, 7]),
    }


@pytest.mark.parametrize("name", list(_cases()))
def test_running_sums_of_crowded_values(spark, monkeypatch, name):
    monkeypatch.setattr(ordering, "CROWDED", 200)
    monkeypatch.setattr(ordering, "PART", 100)
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 0)
    kind, values = _cases()[name]
    df = _spread(spark, values, kind)
    counts = collections.Counter(values)
    order = sorted(counts)
    for down in (False, True):
        got = sorted((tuple(r) for r in running_sums(df, "v", ["w"], descending=down).collect()), reverse=down)
        run, want = 0, []
        seq = order[::-1] if down else order
        for i, v in enumerate(seq):
            run += counts[v]
            want.append((v, counts[v], run, seq[i - 1] if i else None, seq[i + 1] if i + 1 < len(seq) else None))
        assert got == want
    fullest, coarse = _crowd(df)
    # spread evenly: a part has about PART values (one more for the ends of its range); uncut buckets have CROWDED at most
    assert fullest <= 202 if name == "a hot value" else fullest <= max(200 if coarse <= 200 else 0, 102)


def test_ranks_above_2_53(spark):
    values = [2 ** 53 + i for i in range(4)] + [2 ** 53 + 3, None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v bigint")
    assert {r["id"]: r["rank"] for r in average_ranks(df, "v").collect()} == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.5, 4: 4.5, 5: None}
    assert [r["id"] for r in row_numbers(df.where("id < 4"), "v", "id", descending=True).orderBy("rn").collect()] == [3, 2, 1, 0]


def test_quantiles_of_crowded_values(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CROWDED", 200)
    monkeypatch.setattr(ordering, "PART", 100)
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 0)
    rng = np.random.default_rng(3)
    groups = {"epoch": 1.7e9 + rng.integers(0, 90_000, 4_000), "hot": np.concatenate([np.full(900, 2.5), rng.normal(size=2_000)]),
              "one": np.array([4.0]), "two": np.array([-1.0, 9.0]), "wide": 10.0 ** rng.uniform(-200, 200, 500) * rng.choice([-1, 1], 500)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("hot", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    qs = [0.0, 0.01, 0.25, 0.30000000000000004, 0.5, 0.75, 0.999, 1.0]
    for bound in (None, 10):
        got = {(r["k"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", qs, ["k"], bound).collect()}
        assert {k for k, _ in got} == {*groups, None}
        for k, vs in groups.items():
            for q in qs:
                assert math.isclose(got[k, q], float(np.quantile(vs, q)), rel_tol=1e-12)
    assert exact_quantiles(df.where("v is null"), "v", qs).count() == 0


def test_no_sort_of_the_column_in_the_plan(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("v"))
    plan = exact_quantiles(df, "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "percentile" not in plan


# ----------------------------------------------------------------- threshold searches

def _tie(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("seed,window", [(1, 1 << 21), (2, 1 << 21), (2, 40)])
def test_top_levels(spark, monkeypatch, seed, window):
    monkeypatch.setattr(ordering, "WINDOW_ROWS", window)
    monkeypatch.setattr(ordering, "_ROW_BYTES", 1)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0.5, 0.5, round(rng.uniform(0, 2), 2), None if seed == 2 else 1.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(4)
    cuts = [lambda n, i=i: F.floor(n * F.lit(i) / F.lit(10)) for i in range(1, 11)]

    def want(part):
        order = sorted(part, key=lambda r: (r[2] is None, -(r[2] or 0), _tie(r[0]), r[0]))
        ends = [len(order) * i // 10 for i in range(1, 11)]
        return {r[0]: next(i + 1 for i, e in enumerate(ends) if pos < e) for pos, r in enumerate(order) if r[2] is not None}

    assert {r["id"]: r["level"] for r in top_levels(df, "v", "id", cuts).collect()} == want(rows)
    by_key = {}
    for k in ("a", "b", None):
        by_key |= want([r for r in rows if r[1] == k])
    for groups in (None, 3):
        assert {r["id"]: r["level"] for r in top_levels(df, "v", "id", cuts, ["k"], max_groups=groups).collect()} == by_key
    few = [lambda n: F.lit(0), lambda n: F.lit(7)]
    assert len(top_levels(df, "v", "id", few).collect()) == 7
    assert top_levels(df.limit(0), "v", "id", cuts).count() == 0


def test_numbers_and_samples_in_hash_order(spark):
    df = spark.range(3_000).repartition(7).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / F.lit(1000.0)).alias("h"))
    order = [r["id"] for r in df.orderBy("h", "id").collect()]
    got = {r["id"]: r["rn"] for r in number_by_hash(df, F.col("h"), "id").collect()}
    assert [got[i] for i in order] == list(range(1, 3_001))
    for n in (0, 1, 999, 3_000, 5_000):
        assert sorted(r["id"] for r in first_by_hash(df, F.col("h"), "id", n).collect()) == sorted(order[:n])


def test_evenly_spaced_bins_equal_comparisons_with_every_edge(spark):
    from probity.functions.binning import bin_index, even_bin_index, scaled_edges
    rng = random.Random(9)
    rows = []
    for lo, hi in ((0.0, 1.0), (-3.3, 7.1), (1e9, 1e9 + 1e-3), (0.1, 0.1), (-1e-300, 1e-300)):
        edges = [lo if hi == lo else (i / 10 * 100.0) / (100.0 / (hi - lo)) + lo for i in range(11)]
        values = edges + [math.nextafter(e, d) for e in edges for d in (-math.inf, math.inf)] + [rng.uniform(lo, hi) for _ in range(60)] + [lo - 1, hi + 1]
        rows += [(lo, hi, v) for v in values] + [(lo, hi, None)]
    df = spark.createDataFrame(rows, "lo double, hi double, v double").withColumn("e", scaled_edges("lo", "hi", 10))
    assert df.where(~bin_index("v", "e", 10).eqNullSafe(even_bin_index("v", "e", 10))).count() == 0
