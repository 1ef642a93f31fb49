"""Column-level building blocks (JVM-side expressions only)."""

from probity.functions.binning import bin_index, linspace_edges, scaled_edges, unit_edges
from probity.functions.hashing import gaussian, hash01, hash_long, hash_open01, hash_u32, uniform
from probity.functions.util import (as_col, categorical_columns, count_if, numeric_columns, quote,
                                    r6, safe_div, zero_div)

__all__ = [
    "as_col", "bin_index", "categorical_columns", "count_if", "gaussian", "hash01", "hash_long",
    "hash_open01", "hash_u32", "linspace_edges", "numeric_columns", "quote", "r6", "safe_div",
    "scaled_edges", "uniform", "unit_edges", "zero_div",
]
