"""Bin edges and bin membership (H5).

Edges are an ``array<double>`` column (a literal, or a one-row statistic joined in);
membership is a count of edges on one side of the value, written as a plain sum of
comparisons so that it stays inside whole-stage codegen.

Two membership rules exist in the reference:

* ``left``  -- ``[a, b)`` with the last bin closed (numpy ``histogram``);
* ``right`` -- ``(a, b]`` (``pd.cut``, calibration bins); ``include_lowest`` closes
  the first bin on the left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probity.functions.util import as_col


def linspace_edges(lo, hi, n: int) -> Column:
    """``np.linspace(lo, hi, n+1)`` as numpy builds it: ``i*step + lo``, last = hi.

    A zero range widens to ``[lo-0.5, hi+0.5]`` as ``np.histogram`` does.
    """
    lo, hi = as_col(lo).cast("double"), as_col(hi).cast("double")
    same = lo == hi
    lo2 = F.when(same, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(same, hi + F.lit(0.5)).otherwise(hi)
    step = (hi2 - lo2) / F.lit(float(n))
    edges = [F.lit(float(i)) * step + lo2 for i in range(n)] + [hi2]
    return F.array(*edges)


def scaled_edges(lo, hi, n: int) -> Column:
    """Equal-width edges in the reference PSI order of operations.

    Edge i is ``(i/n*100) / (100/(hi-lo)) + lo``.  A zero range gives n+1 copies of lo.
    """
    lo, hi = as_col(lo).cast("double"), as_col(hi).cast("double")
    scale = F.try_divide(F.lit(100.0), hi - lo)
    edges = []
    for i in range(n + 1):
        pct = F.lit(i / n * 100.0)
        edges.append(F.when(hi == lo, lo).otherwise(pct / scale + lo))
    return F.array(*edges)


def unit_edges(n: int) -> Column:
    """``i * (1/n)`` for i in 0..n: numpy ``linspace(0, 1, n+1)`` values."""
    step = 1.0 / n
    return F.array(*[F.lit(1.0 if i == n else i * step) for i in range(n + 1)])


def bin_index(value, edges, n: int, side: str = "left", include_lowest: bool = True) -> Column:
    """0-based bin of ``value`` for ``n`` bins given ``n+1`` edges; null outside the edges."""
    v = as_col(value)
    e = as_col(edges)
    terms = []
    for i in range(1, n):
        ei = F.element_at(e, i + 1)
        cond = (ei <= v) if side == "left" else (ei < v)
        terms.append(F.when(cond, F.lit(1)).otherwise(F.lit(0)))
    idx = F.lit(0)
    for t in terms:
        idx = idx + t
    first, last = F.element_at(e, 1), F.element_at(e, n + 1)
    if side == "left":
        inside = (v >= first) & (v <= last)
    else:
        low_ok = (v >= first) if include_lowest else (v > first)
        inside = low_ok & (v <= last)
    return F.when(inside, idx)


def even_bin_index(value, edges, n: int) -> Column:
    """``bin_index`` with side "left" for edges that are (nearly) evenly spaced.

    The bin follows from the distance to the first edge, up to rounding: its own edges and
    the neighbours' settle it, in place of a comparison with every edge.
    """
    v, e = as_col(value), as_col(edges)
    first, last = F.element_at(e, 1), F.element_at(e, n + 1)
    guess = F.floor(F.try_divide((v - first) * F.lit(float(n)), last - first)).cast("int")
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(guess, F.lit(n - 1))))  # all edges equal: the last bin
    below, above = F.element_at(e, at + 1), F.element_at(e, at + 2)
    settled = at - (v < below).cast("int") + (v >= above).cast("int")
    return F.when((v >= first) & (v <= last), F.greatest(F.lit(0), F.least(F.lit(n - 1), settled)))


def edge_pairs(edges, n: int):
    """(lower, upper) columns for a bin index column named ``bin``."""
    e = as_col(edges)
    b = F.col("bin")
    return F.element_at(e, b + 1), F.element_at(e, b + 2)
