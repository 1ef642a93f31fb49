"""Spark session set-up and lineage handling.

The library never builds its own session inside a diagnostic: every function takes
the caller's DataFrame.  ``get_session`` exists for scripts, tests and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package.
_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "probity",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session gets its own.

    On a cluster the directory must be shared storage named by the cluster; a
    machine-local folder would lose checkpoints with the executor that wrote them.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for it")
    path = tempfile.mkdtemp(prefix="probity-ckpt-", dir=os.environ.get("PROBITY_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return a short-lineage copy.

    Used between iterations (k-means sweep, learning curve) so that a lost executor
    re-reads the checkpoint instead of replaying every earlier step.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
