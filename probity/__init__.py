"""probity: model-audit diagnostics as Spark DataFrame jobs.

Every diagnostic takes a scored DataFrame and returns a DataFrame.
"""

__version__ = "0.1.0"
