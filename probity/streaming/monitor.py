"""Model monitoring over a stream of scored rows (V10 in Structured Streaming).

The batch drift check (``resilience.time_slice_drift``) scores fixed time
slices of a table.  The same slices can be kept up to date as scored rows arrive:
an event-time window with a watermark aggregates counts per slice (accuracy,
Brier score, selection rate, and the bin counts of one feature against bin edges
fixed from a reference sample), and PSI against the reference shares is a
projection of those counts.  All state is per window, bounded by the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.binning import bin_index
from probity.functions.util import as_col
from probity.operators.resilience import PSI_FLOOR
from probity.session import ensure_checkpoint_dir


def reference_profile(reference: DataFrame, feature: str, bins: int = 10) -> tuple[list[float], list[float]]:
    """Equal-width edges over the reference [min, max] and the reference share per
    bin.  Returns two short lists (bins + 1 edges, bins shares): the fitted monitor."""
    from probity.functions.binning import scaled_edges
    st = reference.agg(F.min(as_col(feature)).alias("lo"), F.max(as_col(feature)).alias("hi"),
                       F.count(as_col(feature)).alias("n"))
    edges_row = st.select(scaled_edges("lo", "hi", bins).alias("e"), "n").first()
    edges, n = [float(x) for x in edges_row["e"]], edges_row["n"]
    lit_edges = F.array(*[F.lit(e) for e in edges])
    counts = reference.select(bin_index(as_col(feature).cast("double"), lit_edges, bins).alias("b")) \
                      .groupBy("b").count().collect()
    got = {r["b"]: r["count"] for r in counts if r["b"] is not None}
    return edges, [got.get(i, 0) / n for i in range(bins)]


def slice_metrics(rows: DataFrame, ts: str, feature: str, edges, ref_shares, duration: str = "1 day",
                  watermark: str | None = "1 day", y: str = "y", yh: str = "yh", p: str = "p") -> DataFrame:
    """Per event-time window: n, accuracy, Brier score, selection rate and PSI of
    ``feature`` against the reference shares.  Works on a batch or a streaming
    DataFrame (with ``watermark`` for bounded state)."""
    bins = len(edges) - 1
    ntz = isinstance(rows.schema[ts].dataType, T.TimestampNTZType)
    tz = rows.sparkSession.conf.get("spark.sql.session.timeZone")
    if ntz:
        # Watermarks need TIMESTAMP.  The wall clock is taken as UTC so that windows
        # cut at wall-clock boundaries whatever the session time zone is.
        rows = rows.withColumn(ts, F.from_utc_timestamp(as_col(ts).cast("timestamp"), tz))
    src = rows.withWatermark(ts, watermark) if (watermark and rows.isStreaming) else rows
    lit_edges = F.array(*[F.lit(float(e)) for e in edges])
    b = bin_index(as_col(feature).cast("double"), lit_edges, bins)
    staged = src.select(F.window(as_col(ts), duration).alias("w"), b.alias("_b"),
                        (as_col(y) == as_col(yh)).cast("int").alias("_ok"),
                        F.pow(as_col(p).cast("double") - as_col(y).cast("double"), 2).alias("_sq"),
                        as_col(yh).cast("int").alias("_sel"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("_ok"), F.sum("_sq").alias("_sq"),
            F.sum("_sel").alias("_sel")] + \
           [F.sum(F.when(F.col("_b") == i, 1).otherwise(0)).alias(f"_c{i}") for i in range(bins)]
    g = staged.groupBy("w").agg(*aggs)
    psi = F.lit(0.0)
    for i in range(bins):
        a = F.col(f"_c{i}") / F.col("n")
        a = F.when(F.col(f"_c{i}") == 0, F.lit(PSI_FLOOR)).otherwise(a)
        e = F.lit(float(ref_shares[i]) if ref_shares[i] > 0 else PSI_FLOOR)
        psi = psi + (e - a) * F.log(e / a)
    start = F.to_utc_timestamp(F.col("w.start"), tz) if ntz else F.col("w.start")
    return g.select(F.date_format(start, "yyyy-MM-dd HH:mm").alias("slice"), "n",
                    (F.col("_ok") / F.col("n")).alias("accuracy"), (F.col("_sq") / F.col("n")).alias("brier"),
                    (F.col("_sel") / F.col("n")).alias("selection_rate"), psi.alias("psi"))


def run_monitor(spark: SparkSession, directory: str, schema: T.StructType | str, score, ts: str, feature: str,
                edges, ref_shares, duration: str = "1 day", watermark: str = "1 day", glob: str | None = None,
                sink: str = "memory", path: str | None = None, output_mode: str = "complete",
                checkpoint: str | None = None):
    """Read scored rows as a file stream, keep the slice metrics, and run until the
    files present now are processed (``availableNow``).  ``score`` maps the raw
    stream to (ts, feature, y, yh, p).  Returns the query name (memory sink) or path.

    The checkpoint goes under the session's ``spark.checkpoint.dir`` so that a
    restarted driver resumes the same state.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = score(reader.load(directory))
    out = slice_metrics(stream, ts, feature, edges, ref_shares, duration, watermark)
    name = f"probity_monitor_{uuid.uuid4().hex[:8]}"
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark)}/{name}"
    writer = out.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if sink == "memory":
        q = writer.format("memory").queryName(name).start()
    else:
        q = writer.format(sink).option("path", path).start()
    q.awaitTermination()
    return name if sink == "memory" else path
