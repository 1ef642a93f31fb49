"""Registered checks (Spark query + DuckDB oracle), grouped by operator family."""

from probity.checks import data_checks, diagnostic_checks, metric_checks, model_checks, stream_checks  # noqa: F401
